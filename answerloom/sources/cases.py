"""Labelled evaluation cases from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerloom.functions import text as T

MAX_DOC_CHARS = 255


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected) of JSON-lines files. Blank lines and lines opening with ``#`` are skipped, a byte order mark
    is dropped; a line that is no JSON object is rejected with its line number.

    A case file is hand-labelled and read whole per row, which gives exact line numbers; files spread over tasks.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    return split_cases(files)


def split_cases(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = F.split(F.regexp_replace(F.ltrim("value", F.lit("\ufeff")), "\r\n?", "\n"), "\n")
    rows = files.select("file", F.posexplode(lines).alias("pos", "line"))
    rows = rows.select("file", (F.col("pos") + 1).alias("line_no"), T.trim_ws("line").alias("line"))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parsed = rows.withColumn("v", F.try_parse_json("line"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("v").isNull(), "invalid JSON").when(~is_object, "not a JSON object")
    marked = parsed.withColumn("reason", reason)
    rejected = marked.filter("reason IS NOT NULL").select("file", "line_no", "reason")
    return marked.filter("reason IS NULL").select("file", "line_no", "v"), rejected


def _list(v: Column) -> Column:
    """A JSON list, a single string or nothing, as trimmed distinct strings in order."""
    kind = F.schema_of_variant(v)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).when(
        F.is_variant_null(v) | v.isNull(), F.array().cast("array<string>")
    ).otherwise(F.array(v.cast("string")))
    cleaned = F.filter(F.transform(items, T.trim_ws), lambda x: x != "")
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def normalize_cases(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected): the question is required; names are cut to 255; ``sections`` stands in for
    ``expected_sections`` when that field is absent."""

    def text(path: str) -> Column:
        t = T.trim_ws(F.try_variant_get("v", f"$.{path}", "string"))
        return F.when(t != "", t)

    def part(path: str) -> Column:
        return F.try_variant_get("v", f"$.{path}", "variant")

    sections = F.when(part("expected_sections").isNotNull(), _list(part("expected_sections"))).otherwise(_list(part("sections")))
    out = parsed.select(
        *[c for c in parsed.columns if c != "v"], text("question").alias("question"), text("ground_truth").alias("ground_truth"),
        F.left(text("expected_doc"), F.lit(MAX_DOC_CHARS)).alias("expected_doc"), sections.alias("expected_sections"), _list(part("tags")).alias("tags"),
    )
    keys = [c for c in ("file", "line_no") if c in out.columns]
    return out.filter("question IS NOT NULL"), out.filter("question IS NULL").select(*keys, F.lit("question is required").alias("reason"))
