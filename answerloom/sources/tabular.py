"""Tables and JSON as retrievable text rows."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerloom.functions import text as T

MAX_DEPTH = 20
TRUNCATED = f"<截断：嵌套超过 {MAX_DEPTH} 层>"


def rows_to_text(df: DataFrame, cols: Sequence[str], kv: str = ": ", sep: str = " | ") -> Column:
    """``name: value | name: value`` of a row; missing cells are left out, a nameless column becomes ``col_{i}``."""
    parts = []
    for i, name in enumerate(cols):
        label = name.strip() or f"col_{i}"
        parts.append(F.concat(F.lit(label + kv), T.trim_ws(F.col(f"`{name}`").cast("string"))))
    return F.concat_ws(sep, *parts)


def table_text(files: DataFrame, sep: str = ",", header: bool = True, file: str = "path", text: str = "text") -> DataFrame:
    """(file, row_no, line) of each CSV file that is one row of ``files``: one line per data row, blank rows left out.

    A file's first row names its cells; a cell beyond them, or with a blank name, is ``col_{i}``. A file of names only keeps
    them as its one line. Files are rows of their own, so files of different columns may be read together. A task holds
    one file and its lines at a time; cells have no limit of their own.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)  # cells may be of any length that a task can hold
        for batch in batches:
            out: list[tuple] = []
            for path, body in zip(batch.column(file).to_pylist(), batch.column(text).to_pylist(), strict=True):
                rows = [r for r in csv.reader(io.StringIO(body or "", newline=""), delimiter=sep) if any(c.strip() for c in r)]
                names = [c.strip() for c in rows[0]] if rows and header else []
                data = rows[1:] if header else rows
                named = [" | ".join(f"{(names[i] if i < len(names) else '') or f'col_{i}'}: {c.strip()}" for i, c in enumerate(r)) for r in data]
                if rows and not data:
                    named = [" | ".join(c for c in names if c)]
                out += [(path, i, line) for i, line in enumerate(named, 1)]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((batch.schema.field(file).type, pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "row_no", "line"])

    return files.select(file, text).mapInArrow(lines, f"file {files.schema[file].dataType.simpleString()}, row_no int, line string")


def read_table_text(spark, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV files under a path as text lines (see ``table_text``)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return table_text(files, sep, header).select("file", "row_no", F.col("line").alias("text"))


def flatten_json(df: DataFrame, ids: Sequence[str], json: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(ids, path, value) for every leaf of a JSON column.

    Object steps are ``.key``, list steps ``[i]``, the root ``$``; empty containers and null/true/false are spelled
    out; whatever lies deeper than ``max_depth`` leaves one marker row. Each level is one lateral explode in which
    leaves pass through, so the plan is a chain without joins. Malformed JSON gives no row.
    """
    df = df.select(*ids, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).filter("v IS NOT NULL")
    for _ in range(max_depth):
        steps = df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("_pos", "_key", "_child")
        key = F.when(F.col("path") == "", F.col("_key")).otherwise(F.concat("path", F.lit("."), "_key"))
        step = F.when(F.col("_key").isNotNull(), key).otherwise(F.concat("path", F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        inner = F.col("_pos").isNotNull()
        df = df.lateralJoin(steps).select(
            *ids, F.when(inner, step).otherwise(F.col("path")).alias("path"), F.when(inner, F.col("_child")).otherwise(F.col("v")).alias("v")
        )
    kind, text = F.schema_of_variant("v"), F.col("v").cast("string")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    plain = F.when(nested, F.to_json("v")).otherwise(text)
    value = F.when(F.is_variant_null("v"), "null").when(nested & ~plain.isin("{}", "[]"), TRUNCATED).otherwise(plain)
    return df.select(*ids, F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), value.alias("value"))
