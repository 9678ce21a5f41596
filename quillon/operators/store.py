"""Operators over stored sessions, blobs and registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.values import is_safe_path


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of stored rows with their key."""
    return stored.join(new.select(key), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def verify_blobs(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Wanted (path, sha256) and blobs (sha256, content): ok, missing or corrupt; each blob is hashed once."""
    hashed = blobs.dropDuplicates(["sha256"]).select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("__ok"))
    status = F.when(F.col("__ok").isNull(), "missing").when(F.col("__ok"), "ok").otherwise("corrupt")
    return wanted.join(hashed, "sha256", "left").select("path", "sha256", status.alias("status"))


def bytes_missing(files: DataFrame, have: DataFrame, by: str) -> DataFrame:
    """Files (by, sha256, size) and have (sha256, size): bytes still to be fetched, in all."""
    got = have.select("sha256", F.col("size").alias("__have"))
    left = F.greatest(F.col("size") - F.coalesce("__have", F.lit(0)), F.lit(0))
    return files.join(got, "sha256", "left").groupBy(by).agg(F.sum("size").alias("total"), F.sum(left).alias("missing"))


def complete(files: DataFrame, have: DataFrame, by: str) -> DataFrame:
    """Whether all files are there in full size."""
    got = have.select("sha256", F.col("size").alias("__have"))
    ok = F.coalesce(F.col("size") == F.col("__have"), F.lit(False))
    return files.join(got, "sha256", "left").groupBy(by).agg(F.bool_and(ok).alias("complete"))


def group_processes(processes: DataFrame, owner: str, active: str, name: str) -> DataFrame:
    """One row for each responsible app, active if any of its processes is."""
    return processes.groupBy(owner).agg(F.bool_or(active).alias("active"), F.array_sort(F.collect_set(name)).alias("names"), F.count("*").alias("n"))


def first_prefix(value: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The name of the first prefix, in the list's order, that ``value`` starts with."""
    out = F.lit(None).cast("string")
    for prefix, name in reversed(prefixes):
        out = F.when(value.startswith(prefix), name).otherwise(out)
    return out


def rekey(results: DataFrame, renames: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Results under their new keys (renames old_key, new_key), without those whose key is gone."""
    moved = results.join(renames.select(F.col("old_key").alias(key), "new_key"), key, "left").withColumn(key, F.coalesce("new_key", key)).drop("new_key")
    return moved.join(keys.select(key).distinct(), key, "left_semi").select(*results.columns)


def recover(sessions: DataFrame, final: DataFrame, partial: DataFrame, key: str, column: str) -> DataFrame:
    """The final transcript, else the last partial one."""
    out = sessions.join(final.select(key, F.col(column).alias("__f")), key, "left").join(partial.select(key, F.col(column).alias("__p")), key, "left")
    source = F.when(F.col("__f").isNotNull(), "final").when(F.col("__p").isNotNull(), "partial").otherwise("none")
    return out.select(key, F.coalesce("__f", "__p").alias(column), source.alias("source"))


def second_chunks(frames: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.05) -> DataFrame:
    """Numbers chunks of one second that start anew where sound breaks off."""
    w = Window.partitionBy(*keys).orderBy(start)
    broken = F.col(start) - F.lag(end).over(w) > gap
    rows = frames.withColumn("__new", F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("piece", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.min(start).over(Window.partitionBy(*keys, "piece"))
    return rows.withColumn("chunk", F.floor(F.col(start) - base)).drop("__new")


def clip(chunks: DataFrame, low: float, high: float) -> DataFrame:
    """Chunks (start, end) cut to [low, high)."""
    inside = chunks.filter((F.col("start") < high) & (F.col("end") > low))
    return inside.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(high))})


def problems(files: DataFrame, model: str) -> DataFrame:
    """Files (model, path, sha256, url) of manifests: unsafe paths, bad digests, plain addresses, repeated
    paths, and files that are also folders of others."""
    from quillon.functions.values import is_safe_path, is_sha256

    own = files.select(model, "path", F.explode(F.filter(F.array(
        F.when(~is_safe_path(F.col("path")), "unsafe_path"), F.when(~is_sha256(F.col("sha256")), "bad_digest"), F.when(~F.col("url").startswith("https://"), "plain_address")
    ), lambda x: x.isNotNull())).alias("problem"))
    twice = files.groupBy(model, "path").count().filter("count > 1").select(model, "path", F.lit("repeated_path").alias("problem"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = files.filter(F.size(parts) > 1).select(model, F.explode(above).alias("path")).distinct()
    folder = files.select(model, "path").distinct().join(folders, [model, "path"], "left_semi").select(model, "path", F.lit("file_is_folder").alias("problem"))
    return own.unionByName(twice).unionByName(folder)


def live_digests(*registrations: DataFrame) -> DataFrame:
    """The distinct digests that any registration names."""
    out = registrations[0].select("sha256")
    for more in registrations[1:]:
        out = out.unionByName(more.select("sha256"))
    return out.filter("sha256 is not null").distinct()


def custom_manifests(models: DataFrame) -> DataFrame:
    """Manifests for models that users bring: models (url, sha256, size, display_name, format, min_ram_gb) to the columns
    of a manifest with one file; those without a url are local and have none. A file's name is that of the url if it may be
    a part of a path, else the format's."""
    name = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    path = F.when(is_safe_path(name) & (name != ""), name).otherwise(F.concat(F.lit("model."), "format"))
    return models.filter(F.col("url").isNotNull()).select(
        F.concat(F.lit("custom-"), F.substring("sha256", 1, 16)).alias("id"), "display_name", "format", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("source"),
        F.concat(F.lit("sha256-"), "sha256").alias("revision"), F.lit("unknown (user-supplied)").alias("license"), F.coalesce("min_ram_gb", F.lit(0)).alias("min_ram_gb"),
        path.alias("path"), "url", "sha256", "size", F.lit(False).alias("validated"),
    )
