"""Dense vectors: hash embedding, normalising, exact and bucketed cosine search, counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerloom.functions.filters import where_to_column
from answerloom.operators.skew import SALTS, top_per_group

#: Query vectors above these bounds are matched block by block instead of being sent to every task.
MAX_SHARED_QUERIES = 20_000
MAX_SHARED_BYTES = 256 * 1024 * 1024
BLOCK_ROWS = 50_000
#: Texts embedded, and (query, vector) scores held, at once by a task.
TEXTS, SCORES = 256, 1_000_000

_NOT_ALNUM = re.compile(r"[\W_]+")
_PAIR = 1 << 42  # codes of 2-grams start here


class DimensionError(ValueError):
    """Vectors of different length met in one search."""


# --- embedding --------------------------------------------------------------------------------------------------
def _hash_matrix(texts: list[str | None], dim: int, known: dict[int, tuple[int, float]]) -> list[np.ndarray]:
    """Signed gram counts per bucket. A gram is coded as one integer; its md5 is taken once per task."""
    out = []
    for text in texts:
        codes = np.frombuffer(_NOT_ALNUM.sub("", text or "").lower().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        grams, counts = np.unique(np.r_[codes, (codes[:-1] << 21 | codes[1:]) + _PAIR], return_counts=True)
        slots = []
        for gram in grams.tolist():
            slot = known.get(gram)
            if slot is None:
                plain = gram if gram < _PAIR else gram - _PAIR
                token = chr(plain) if gram < _PAIR else chr(plain >> 21) + chr(plain & 0x1FFFFF)
                h = int(hashlib.md5(token.encode()).hexdigest()[:15], 16)  # noqa: S324 - a bucket, not a secret
                slot = known[gram] = (h % dim, -1.0 if h >> 59 & 1 else 1.0)
            slots.append(slot)
        buckets = np.array([b for b, _ in slots], dtype=np.int64)
        signs = np.array([g for _, g in slots])
        vec = np.bincount(buckets, weights=signs * counts, minlength=dim) if len(slots) else np.zeros(dim)
        size = np.sqrt((vec * vec).sum())
        out.append(vec / size if size > 0 else vec)
    return out


def hash_embed(text: Column | str, dim: int) -> Column:
    """Deterministic unit vector of a text without a model; no letters or digits give the zero vector.

    Letters and digits of the whole text, lower-cased, form 1-grams and adjacent 2-grams. The leading 60 bits of the
    md5 of a gram choose its bucket (modulo ``dim``) and, by the top bit, its sign. It runs in Arrow batches beside
    the scan: built-in functions would have to explode every character and shuffle the grams (measured 15x slower). Few
    texts of a batch are Python strings at a time, and the vectors stay in one flat array.
    """

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[int, tuple[int, float]] = {}
        for texts in batches:
            flat = np.zeros((len(texts), dim))
            for i in range(0, len(texts), TEXTS):
                flat[i : i + TEXTS] = _hash_matrix(texts.slice(i, TEXTS).to_pylist(), dim, known)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(flat.ravel()))

    return embed(text)


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vec: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return F.transform(
        F.array(vec),
        lambda v: F.transform(
            F.array(l2_norm(v)),
            lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))),
        )[0],
    )[0]


def embed_with(
    df: DataFrame,
    text: str,
    fn: Callable[[], Callable[[list[str]], list[list[float]]]],
    dim: int,
    batch: int = 16,
    mode: str = "model",
    fallback: bool = True,
) -> DataFrame:
    """Embed with a user's model: ``fn`` builds it once per task, then gets lists of at most ``batch`` texts.

    The result has ``embedding``, ``embed_mode`` and ``embed_error``. Row count and dimension are checked; a failing
    batch gives NULL vectors with the reason when ``fallback`` is set, for ``degrade_to_hash`` to fill.
    """
    schema = df.schema.simpleString()[7:-1] + ",embedding:array<float>,embed_mode:string,embed_error:string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                try:
                    model = model or fn()
                    vectors = model(part[text].fillna("").tolist())
                    if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                        raise DimensionError(f"model returned a wrong number or size of vectors, expected {dim}")
                    unit = np.asarray(vectors, dtype=np.float64)
                    size = np.linalg.norm(unit, axis=1, keepdims=True)
                    unit = np.divide(unit, size, out=np.zeros_like(unit), where=size > 0)
                    unit[part[text].fillna("").str.strip().eq("").to_numpy()] = 0.0
                    part["embedding"], part["embed_mode"], part["embed_error"] = list(unit.astype("float32")), mode, None
                except Exception as exc:  # noqa: BLE001 - the reason is reported per row
                    if not fallback:
                        raise
                    part["embedding"], part["embed_mode"] = None, "failed"
                    part["embed_error"] = f"{type(exc).__name__}: {exc}"[:500]
                yield part

    return df.mapInPandas(run, schema)


def degrade_to_hash(embedded: DataFrame, text: str, dim: int) -> DataFrame:
    """Replace a whole embedding run by hash vectors when any row failed; one index never mixes embedders."""
    failed = embedded.agg(F.coalesce(F.bool_or(F.col("embed_mode") == "failed"), F.lit(False))).first()[0]
    if not failed:
        return embedded
    rest = [c for c in embedded.columns if c not in ("embedding", "embed_mode")]
    return embedded.select(*rest, hash_embed(text, dim).alias("embedding"), F.lit("hash").alias("embed_mode"))


# --- exact search -----------------------------------------------------------------------------------------------
def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of the best ``k`` per row by (score desc, key asc); -inf marks excluded pairs."""
    n = scores.shape[1]
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    else:
        rows, cols = np.nonzero(scores > -np.inf)
    order = np.lexsort((keys[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    position = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return rows[position < k], cols[position < k]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) == 0:
        return np.zeros((0, 0))
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False)
    if len(np.unique(lengths)) != 1:
        raise DimensionError("vectors of different dimension in one table")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), lengths[0])


def _query_side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ids, matrix, and the collection each query is bound to (or None)."""
    kbs = table.column("kb_id").to_pandas().to_numpy() if "kb_id" in table.column_names else None
    return table.column("query_id").to_pandas().to_numpy(), _matrix(table.column("embedding")), kbs


def _scan(side: tuple, keys: np.ndarray, kbs: np.ndarray, vectors: np.ndarray, k: int, per_kb: bool) -> pd.DataFrame:
    """Best ``k`` of one block of vectors for every query; blocks of queries bound the score matrix."""
    ids, matrix, bound = side
    if matrix.size and vectors.size and matrix.shape[1] != vectors.shape[1]:
        raise DimensionError(f"query dimension {matrix.shape[1]} differs from {vectors.shape[1]}")
    parts = []
    step = max(1, SCORES // max(len(keys), 1))
    groups = [kbs == kb for kb in pd.unique(kbs)] if per_kb else [np.ones(len(keys), bool)]
    for mask in groups:
        sub_keys, sub_kbs, sub_vec = keys[mask], kbs[mask], vectors[mask]
        for start in range(0, len(ids), step):
            rows = slice(start, start + step)
            scores = np.round(matrix[rows] @ sub_vec.T, 9)
            if bound is not None:
                scores[bound[rows][:, None] != sub_kbs[None, :]] = -np.inf
            r, c = _best(scores, sub_keys, k)
            parts.append(
                pd.DataFrame(
                    {"query_id": ids[rows][r], "kb_id": sub_kbs[c], "chunk_key": sub_keys[c], "vector_score": scores[r, c]}
                )
            )
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    where: Mapping[str, Any] | None = None,
    per_kb: bool = False,
    shared: bool | None = None,
) -> DataFrame:
    """Exact cosine top-k of unit vectors by (score, key), for a table of queries at once.

    queries(query_id, embedding[, kb_id]) and vectors(kb_id, chunk_key, embedding, ...). A query with ``kb_id`` looks
    into that collection only. ``where`` filters the vectors before scoring and is pushed into their scan.

    A query table of at most ``MAX_SHARED_QUERIES`` rows and ``MAX_SHARED_BYTES`` is sent to every task, which scores its own vectors batch by batch
    and keeps ``k`` per query: the vectors are not shuffled. A larger query table is cut into blocks that meet blocks
    of vectors in a co-grouped join; each meeting again keeps only ``k`` per query. Both ways are exact.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    vectors = vectors.filter(where_to_column(where, vectors.schema)).select("kb_id", "chunk_key", "embedding")
    bound = ["kb_id"] if "kb_id" in queries.columns else []
    queries = queries.select("query_id", *bound, "embedding").filter(F.col("embedding").isNotNull())
    side = queries.limit(MAX_SHARED_QUERIES + 1).toArrow() if shared is not False else None
    if side is not None and side.num_rows <= MAX_SHARED_QUERIES and side.nbytes <= MAX_SHARED_BYTES:
        partial = _topk_shared(queries, side, vectors, k, per_kb)
    else:
        partial = _topk_blocks(queries, vectors, k, per_kb)
    group = ["query_id", "kb_id"] if per_kb else ["query_id"]
    return top_per_group(partial, group, [F.desc("vector_score"), F.asc("chunk_key")], k, "vector_rank")


def _hit_schema(queries: DataFrame, vectors: DataFrame) -> str:
    q, v = dict(queries.dtypes), dict(vectors.dtypes)
    return f"query_id {q['query_id']}, kb_id {v['kb_id']}, chunk_key {v['chunk_key']}, vector_score double"


def _topk_shared(queries: DataFrame, table: pa.Table, vectors: DataFrame, k: int, per_kb: bool) -> DataFrame:
    side = queries.sparkSession.sparkContext.broadcast(_query_side(table))  # measured to be small by the caller
    group = ["query_id", "kb_id"] if per_kb else ["query_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            keys = batch.column("chunk_key").to_pandas().to_numpy()
            kbs = batch.column("kb_id").to_pandas().to_numpy()
            found = _scan(side.value, keys, kbs, _matrix(batch.column("embedding")), k, per_kb)
            if not len(found):
                continue
            merged = found if best is None else pd.concat([best, found], ignore_index=True)
            merged = merged.sort_values([*group, "vector_score", "chunk_key"], ascending=[True] * len(group) + [False, True])
            best = merged.groupby(group, sort=False).head(k)
        if best is not None and len(best):
            yield from pa.Table.from_pandas(best, schema=arrow_schema, preserve_index=False).to_batches()

    schema = _hit_schema(queries, vectors)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return vectors.mapInArrow(scan, schema)


def _topk_blocks(queries: DataFrame, vectors: DataFrame, k: int, per_kb: bool) -> DataFrame:
    """Vectors and queries are cut into hashed blocks; every (vector block, query block) pair is one small task."""
    n_vec = max(SALTS, -(-vectors.count() // BLOCK_ROWS))
    n_query = max(1, -(-queries.count() // BLOCK_ROWS))
    v = vectors.withColumn("vb", F.pmod(F.xxhash64("chunk_key"), F.lit(n_vec)).cast("int"))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int"))
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_vec - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = pd.DataFrame()
        if left.num_rows and right.num_rows:
            keys, kbs = left.column("chunk_key").to_pandas().to_numpy(), left.column("kb_id").to_pandas().to_numpy()
            found = _scan(_query_side(right), keys, kbs, _matrix(left.column("embedding")), k, per_kb)
        return pa.Table.from_pandas(found, schema=arrow_schema, preserve_index=False) if len(found) else arrow_schema.empty_table()

    schema = _hit_schema(queries, vectors)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(meet, schema)


# --- bucketed search --------------------------------------------------------------------------------------------
def with_signatures(df: DataFrame, dim: int, tables: int, bits: int, seed: int = 7) -> DataFrame:
    """One row per hash table with the sign pattern of the vector against that table's random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
    weights = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def signature(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        if matrix.shape[1] != dim:
            raise DimensionError(f"expected dimension {dim}, found {matrix.shape[1]}")
        bit = (matrix @ planes.T >= 0).reshape(len(matrix), tables, bits)
        return pd.Series(list((bit * weights).sum(axis=2).astype("int32")))

    return df.select("*", F.posexplode(signature("embedding")).alias("_table", "_sig"))


def dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_topk_lsh(
    queries: DataFrame, vectors: DataFrame, k: int, dim: int, tables: int = 12, bits: int = 5, salts: int = 8
) -> DataFrame:
    """Approximate top-k: candidates share a bucket in at least one hash table and are rescored exactly.

    Buckets meet on (table, signature, salt) and the collection; the salt splits a hot bucket over ``salts`` tasks. A meeting
    scores its pairs by matrix products and keeps ``k`` per query, and only those leave; every table keeps ``k`` per query of
    them, and the tables' lists are merged after it.
    """
    bound = ["kb_id"] if "kb_id" in queries.columns else []
    v = with_signatures(vectors.select("kb_id", "chunk_key", "embedding").dropna(subset=bound), dim, tables, bits)
    v = v.withColumn("_salt", F.pmod(F.xxhash64("chunk_key"), F.lit(salts)).cast("int"))
    q = with_signatures(queries.select("query_id", *bound, "embedding").dropna(subset=bound), dim, tables, bits)
    q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return arrow_schema.empty_table()
        keys, kbs = left.column("chunk_key").to_pandas().to_numpy(), left.column("kb_id").to_pandas().to_numpy()
        ids, matrix, _ = _query_side(right)
        found = _scan((ids, matrix, None), keys, kbs, _matrix(left.column("embedding")), k, False)
        return pa.Table.from_pandas(found.assign(_table=key[0].as_py()), schema=arrow_schema, preserve_index=False)

    schema = f"_table int, {_hit_schema(queries, vectors)}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    bucket = ["_table", "_sig", "_salt", *bound]
    scored = v.groupBy(*bucket).cogroup(q.groupBy(*bucket)).applyInArrow(meet, schema)
    order = [F.desc("vector_score"), F.asc("chunk_key")]
    lists = top_per_group(scored, ["query_id", "_table"], order, k, "_r")
    merged = lists.groupBy("query_id", "kb_id", "chunk_key").agg(F.max("vector_score").alias("vector_score"))
    return top_per_group(merged, ["query_id"], order, k, "vector_rank")


# --- listings and bulk comparison -------------------------------------------------------------------------------
def vector_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("kb_id").agg(F.count("*").alias("vectors"))


def vector_keys(vectors: DataFrame, doc_id: int | None = None) -> DataFrame:
    rows = vectors if doc_id is None else vectors.filter(F.col("doc_id") == doc_id)
    return rows.select("kb_id", "chunk_key")


def best_pos_neg(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Best score inside and outside the expected class per query; queries(query_id, label, embedding).

    The search runs per class (the class is the collection of ``per_kb``), so each query brings one row per class and
    nothing near queries x vectors is ever written. The query itself (same key) does not compete.
    """
    by_class = vectors.select(F.col("label").alias("kb_id"), "chunk_key", "embedding")
    best = vector_topk(queries.select("query_id", "embedding"), by_class, 2, per_kb=True)
    others = best.filter(F.col("chunk_key") != F.col("query_id"))
    labelled = others.join(queries.select("query_id", "label"), "query_id")
    same = F.col("kb_id") == F.col("label")
    return labelled.groupBy("query_id").agg(
        F.max(F.when(same, F.col("vector_score"))).alias("positive"),
        F.max(F.when(~same, F.col("vector_score"))).alias("negative"),
    )
