"""Sources of JSON records with a policy for each about what can't be read, folders found by their files' names, and the
form library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillon.operators.forms import path_matches

#: What a source does about records that can't be read.
KEEP, SKIP, FAIL = "keep", "skip", "fail"
CORRUPT = "__corrupt"
#: Fixed value: what audio files end with.
AUDIO = ["wav", "m4a", "mp3", "aiff", "aif", "caf", "flac"]
#: Fixed value: the template of a form that has none.
STANDARD_TEMPLATE = "standard"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_records(spark: SparkSession, path: str, schema: str | StructType, policy: str = SKIP, whole_files: bool = False, missing_is_empty: bool = False) -> DataFrame:
    """JSON records with their file in ``path_name``. Of those that can't be read, ``keep`` gives a row with the text
    in ``corrupt`` and nulls, ``skip`` leaves them out, ``fail`` ends the job: what decides about deleting must not guess.
    A path that isn't there is an error, or an empty table where the source says so."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if missing_is_empty and not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("path_name", F.lit(None).cast("string"))
    reader = spark.read.option("multiLine", str(whole_files).lower()).option("recursiveFileLookup", "true")
    file = F.col("_metadata.file_path").alias("path_name")
    if policy == KEEP:
        held = StructType(schema.fields).add(CORRUPT, StringType())
        rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(held).json(path)
        return rows.select(*[F.col(f.name) for f in schema.fields], F.col(CORRUPT).alias("corrupt"), file)
    return reader.option("mode", "FAILFAST" if policy == FAIL else "DROPMALFORMED").schema(schema).json(path).select(*[F.col(f.name) for f in schema.fields], file)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of all files below ``path``; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("path_name"))


def sessions_of(files: DataFrame, root: Column | None = None, path: str = "path_name") -> DataFrame:
    """Folders that are sessions: they hold a client track and a reference.json; folder, name, client, worker (null
    without one), of several tracks the first by name. With ``root``, a session right there is the only one."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    track = lambda who: F.min(F.when((stem == who) & suffix.isin(AUDIO), F.col(path)))
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    out = files.groupBy(folder.alias("folder")).agg(track("client").alias("client"), track("worker").alias("worker"), F.bool_or(name == "reference.json").alias("__reference"))
    out = out.filter(F.col("client").isNotNull() & F.col("__reference")).drop("__reference")
    if root is not None:
        at_root = F.col("folder") == root
        if out.filter(at_root).limit(1).count():
            out = out.filter(at_root)
        else:
            out = out.filter(F.regexp_extract("folder", r"^(.*)/[^/]*$", 1) == root)
    return out.select("folder", F.regexp_extract("folder", r"([^/]*)$", 1).alias("name"), "client", "worker")


def form_library(mappings: DataFrame, profiles: DataFrame, templates: DataFrame) -> DataFrame:
    """Forms from three sources keyed by ``form``: mappings (form, name, fingerprint, origin, path_pattern), profiles
    (form, origin, path_pattern) and templates (form, ids array). A form needs both of the first; without templates it has
    the standard one; a mapping without a name is named by its profile's address. ``place`` puts them in the order of their names."""
    p = profiles.select("form", F.col("origin").alias("p_origin"), F.col("path_pattern").alias("p_path"))
    rows = mappings.join(p, "form").join(templates.select("form", "ids"), "form", "left")
    ids = F.when(F.size(F.coalesce("ids", F.array().cast("array<string>"))) > 0, F.col("ids")).otherwise(F.array(F.lit(STANDARD_TEMPLATE)))
    name = F.coalesce("name", F.concat("p_origin", "p_path"))
    return rows.select("form", name.alias("name"), "fingerprint", "origin", "path_pattern", ids.alias("templates"), F.struct(name.alias("name"), "form").alias("place"))


def template_of(templates: Column, wanted: Column) -> Column:
    """The wanted template if the form has it, else its first."""
    return F.when(F.array_contains(templates, wanted), wanted).otherwise(F.get(templates, F.lit(0)))


def form_by_fingerprint(pages: DataFrame, library: DataFrame) -> DataFrame:
    """Pages (page_id, fingerprint) with the first form by name that has the fingerprint, null without one."""
    first = library.groupBy("fingerprint").agg(F.min_by("form", "place").alias("form"))
    return pages.join(first, "fingerprint", "left").select("page_id", "form")


def form_by_address(pages: DataFrame, library: DataFrame, url: str = "url") -> DataFrame:
    """Pages (page_id, url) with the first form by name whose origin is the page's and whose path pattern fits. Pages
    meet only the forms of their own origin."""
    origin, path = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    rows = pages.select("page_id", F.lower(origin).alias("origin"), path.alias("path"))
    hits = rows.join(library.select(F.lower("origin").alias("origin"), "path_pattern", "form", "place"), "origin").filter(path_matches(F.col("path"), F.col("path_pattern")))
    first = hits.groupBy("page_id").agg(F.min_by("form", "place").alias("form"))
    return rows.select("page_id").join(first, "page_id", "left")
