"""JSON contracts with explicit schemas and a version gate, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<id:string,speaker:string,start:double,end:double,text:string,confidence:double>"
GAP = "struct<track:string,start:double,end:double,reason:string>"
TRANSCRIPT = f"schema string, session_id string, started_at string, retention string, tracks map<string,struct<source:string>>, segments array<{SEGMENT}>, gaps array<{GAP}>, other_voices array<struct<start:double,end:double>>"
EVIDENCE = "array<struct<segment:string,quote:string>>"
FIELD_RESULT = f"key string, status string, value string, evidence {EVIDENCE}, reject_reason string, model string, prefill_tokens int, ms int"
FIELD = "struct<key:string,step:string,kind:string,label:string,help:string,required:boolean,options:array<struct<value:string,label:string>>,write:string,computed:boolean>"
PROFILE = f"schema string, origin string, path_pattern string, fingerprint string, fields array<{FIELD}>"
MAPPING_FIELD = "struct<intent:string,mode:string,evidence_speaker:string,option_semantics:map<string,string>,max_chars:int,derive:struct<function:string,inputs:array<string>>,exclude_options:array<string>,per_month_bands:map<string,array<double>>>"
MAPPING = f"schema string, profile_fingerprint string, name string, fields map<string,{MAPPING_FIELD}>"
AUDIT = "seq bigint, time string, session string, event string, details map<string,string>, prev string, hash string"
TRUTH = "schema string, id string, origin string, source string, seed bigint, labels map<string,struct<label:string,acceptable:array<string>,mode:string,agree:boolean>>"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Documents of one contract; a malformed one ends the read. ``path_name`` is the file's path."""
    rows = spark.read.schema(schema).options(multiLine=str(multi_line).lower(), mode="FAILFAST", recursiveFileLookup="true").json(path)
    return rows.withColumn("path_name", F.col("_metadata.file_path"))


def of_version(df: DataFrame, tag: str) -> DataFrame:
    """Only documents of that schema version are read; any other raises."""
    wrong = F.raise_error(F.concat(F.lit(f"expected schema {tag}, found "), F.coalesce("schema", F.lit("none"))))
    return df.withColumn("schema", F.when(F.col("schema").eqNullSafe(F.lit(tag)), F.col("schema")).otherwise(wrong.cast("string")))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def values_of(text: Column) -> tuple[Column, Column]:
    """a JSON value that is a string or a list of strings: (values array<string>, is_multi)."""
    is_multi = F.coalesce(F.ltrim(text).startswith("["), F.lit(False))
    single = F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(is_multi, F.from_json(text, "array<string>")).otherwise(single), is_multi


def segments(transcripts: DataFrame) -> DataFrame:
    """One row for each segment of JSON transcripts."""
    return transcripts.select("session_id", F.posexplode("segments").alias("seq", "s")).select("session_id", F.col("seq") + 1, "s.*").toDF("session_id", "seq", "segment_id", "speaker", "start", "end", "text", "confidence")


def field_results(spark: SparkSession, path: str) -> DataFrame:
    """Results in file order; a value counts only if its status says it was filled or derived."""
    rows = read_json(spark, path, FIELD_RESULT)
    values, is_multi = values_of(F.col("value"))
    used = F.col("status").isin("filled", "derived")
    empty = F.array().cast("array<string>")
    return rows.withColumns({"run": stem_of(F.col("path_name")), "values": F.when(used, values).otherwise(empty), "is_multi": is_multi}).drop("path_name")


def truth_labels(spark: SparkSession, path: str, scope: list[str] | None = None) -> DataFrame:
    """One row for each label of ``truth.json`` files; ``agreed`` tells those both sources gave."""
    rows = read_json(spark, path, TRUTH).filter(F.col("path_name").endswith("/truth.json"))
    each = rows.select("id", "source", folder_of(F.col("path_name")).alias("folder"), F.explode("labels").alias("field", "l"))
    label, _ = values_of(F.col("l.label"))
    out = each.select("id", "source", "folder", "field", label.alias("label"), "l.acceptable", "l.mode", F.coalesce("l.agree", F.lit(False)).alias("agreed"))
    return out.filter(F.col("field").isin(scope)) if scope is not None else out


def forms(profiles: DataFrame, mappings: DataFrame) -> DataFrame:
    """Profiles with their mapping by name; a form that lacks either is left out."""
    p = profiles.select(stem_of(F.col("path_name")).alias("form"), "origin", "path_pattern", "fingerprint", F.col("fields").alias("profile_fields"))
    m = mappings.select(stem_of(F.col("path_name")).alias("form"), "name", "profile_fingerprint", F.col("fields").alias("mapping_fields"))
    return p.join(m, "form").withColumn("drifted", F.col("fingerprint") != F.col("profile_fingerprint"))


def fields_with_mapping(forms_df: DataFrame) -> DataFrame:
    """Each field of a form with its mapping, null where it has none."""
    rows = forms_df.select("form", F.posexplode("profile_fields").alias("ordinal", "field"), "mapping_fields")
    return rows.select("form", "ordinal", "field.*", F.element_at("mapping_fields", F.col("field.key")).alias("mapping"))


def egress_payload(fields: DataFrame) -> DataFrame:
    """Only the columns that may leave, of fields that aren't decided in code; a fixed list, so that a new
    column never leaves unnoticed."""
    kept = fields.filter("not coalesce(computed, false) and kind <> 'hidden'")
    return kept.select("form", "ordinal", "key", "step", "kind", "label", "help", "required", "options")


def write_results(results: DataFrame, path: str) -> DataFrame:
    """JSON lines with columns in name order; returns the count of each status."""
    results.select(*sorted(results.columns)).write.json(path)
    return results.groupBy("status").agg(F.count("*").alias("n"))


def write_dataset(rows: DataFrame, path: str, by: tuple[str, ...] = ("kind", "split")) -> None:
    """JSON lines in a folder for each kind and split."""
    rows.write.partitionBy(*by).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and SHA-256 of each file of a written dataset."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
