"""Corpus administration: index writing, deletion, consistency, statistics, listings, report sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T_

from answerloom import schema as S
from answerloom.functions import text as T
from answerloom.functions.filters import live, search_name
from answerloom.operators.bm25 import Bm25Index, changed, corpus_stats, doc_stats, merged_corpus, merged_terms, postings_and_records, term_stats
from answerloom.operators.impact import RECORDS, blocked, merged
from answerloom.operators.skew import bounded_join, within_bounds
from answerloom.operators.vectors import l2_normalize
from answerloom.session import shared_dir

STATUSES = ["UPLOADED", "READY", "FAILED", "DELETED"]


# --- index tables -----------------------------------------------------------------------------------------------
def screen_vectors(df: DataFrame, dim: int, kb_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) vectors: wrong dimension or missing key is refused; a given ``kb_id`` wins; the accepted
    ones are unit length, and of several rows with one key one stays: the latest by ``seq`` where there is one, else the
    one that is largest by its values, so that repeating a write changes nothing."""
    if kb_id is not None:
        df = df.withColumn("kb_id", F.lit(kb_id))
    reason = F.when(F.col("chunk_key").isNull() | F.col("kb_id").isNull(), "missing key").when(
        F.coalesce(F.size("embedding"), F.lit(-1)) != dim, "wrong dimension"
    )
    marked = df.withColumn("reason", reason)
    good = marked.filter("reason IS NULL").drop("reason").withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))
    rest = [c for c in good.columns if c not in ("kb_id", "chunk_key", "seq")]
    order = F.struct(*(["seq"] if "seq" in df.columns else []), *rest)
    good = good.groupBy("kb_id", "chunk_key").agg(F.max(order).alias("r")).select("kb_id", "chunk_key", "r.*")
    return good, marked.filter("reason IS NOT NULL").select("kb_id", "chunk_key", "reason")


def write_vectors(df: DataFrame, path: str, dim: int, kb_id: str | None = None) -> DataFrame:
    """Upsert vectors by key into a table partitioned by collection; returns the rejects.

    The incoming rows are evaluated once, into the shared folder. Only partitions named by them are read and replaced; the
    merged rows are checkpointed first, since a partition cannot be overwritten while it is read.
    """
    spark = df.sparkSession
    df = _checkpointed(df)
    good, rejected = screen_vectors(df, dim, kb_id)
    merged = good.drop("seq")
    if _exists(spark, path):
        old = read_stored(spark, path, merged.schema)
        touched = good.select("kb_id").distinct()
        kept = bounded_join(old, touched, ["kb_id"], "left_semi").join(good.select("kb_id", "chunk_key"), ["kb_id", "chunk_key"], "left_anti")
        merged = _checkpointed(merged.unionByName(kept))
    _replace_partitions(merged, path, ["kb_id"], [])
    return rejected


def read_stored(spark: SparkSession, path: str, schema: T_.StructType | str) -> DataFrame:
    """A stored table with its declared schema: without one, partition values like ``007`` would come back as numbers."""
    return spark.read.schema(schema).parquet(path)


def write_bm25_index(chunks: DataFrame, path: str, named: DataFrame | None = None) -> Bm25Index:
    """Write the index of the collections of ``chunks`` and of ``named`` (kb_id), and read the whole index back.

    A named collection without chunks is cleared. Postings are clustered by collection and chunk, the order in which they are counted:
    no reader skips postings by term, and sorting all of them by it took as long as counting.
    """
    kbs = chunks.select("kb_id") if named is None else chunks.select("kb_id").union(named.select("kb_id"))
    _commit_chunks(chunks, kbs.distinct(), path)
    return read_bm25_index(chunks.sparkSession, path)


def append_segment(chunks: DataFrame, path: str, batch: int | None = None) -> Bm25Index:
    """Add chunks whose keys the index does not hold yet as one more segment of their collections.

    Nothing stored is read or written again: postings, lengths and blocks of the segment stand beside the older ones, its term and
    corpus counts are added to theirs by the reader. ``batch`` is kept with the commit (``last_batch``). A key that is
    there already would count twice: use ``update_bm25_index`` for it.
    """
    _commit_chunks(chunks, chunks.select("kb_id").distinct(), path, append=True, batch=batch)
    return read_bm25_index(chunks.sparkSession, path)


def compact_index(spark: SparkSession, path: str, segments: int = 1) -> Bm25Index:
    """Fold the segments of every collection that has more than ``segments`` into one, in one commit; without any, nothing is written."""
    version = _last_version(spark, path)
    named = segment_counts(spark, path).where(F.col("segments") > segments).select("kb_id")
    if version.segmented and not named.isEmpty():
        named = _checkpointed(named)
        part = lambda table, schema: bounded_join(version.live(table, schema), named, ["kb_id"], "left_semi")
        _commit_index(part("postings", S.POSTINGS), part("doc_stats", S.DOC_STATS), named, path, blocks=merged(part("blocks", RECORDS)))
    return read_bm25_index(spark, path)


def segment_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kb_id, segments) of the last version."""
    return _segments(spark, path).groupBy("kb_id").agg(F.count("*").alias("segments"))


def update_bm25_index(path: str, upserts: DataFrame, deletes: DataFrame, batch: int | None = None) -> Bm25Index:
    """Replace the upserted chunks and drop the deleted ones, (kb_id, chunk_key), in a stored index; only the collections
    named in either are read and written again, as one segment each, and one that loses its last chunk becomes empty."""
    spark = upserts.sparkSession
    version = _last_version(spark, path)
    named = _checkpointed(upserts.select("kb_id").union(deletes.select("kb_id")).distinct())
    part = lambda df: bounded_join(df, named, ["kb_id"], "left_semi")
    post, lengths = changed(part(version.live("postings", S.POSTINGS)), part(version.live("doc_stats", S.DOC_STATS)), upserts, deletes)
    _commit_index(post, lengths, named, path, batch=batch)
    return read_bm25_index(spark, path)


def remove_from_index(path: str, doc_ids: DataFrame, chunks: DataFrame) -> Bm25Index:
    """Take the chunks of doc_ids(doc_id) out of a stored index, in one commit."""
    keys = bounded_join(chunks, doc_ids.select("doc_id").distinct(), ["doc_id"], "left_semi").select("kb_id", "chunk_key")
    return update_bm25_index(path, chunks.limit(0), keys)


def index_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and generation of the last commit, None before the first."""
    if not _exists(spark, f"{path}/head"):
        return None
    row = read_stored(spark, f"{path}/head", S.HEAD).agg(F.max(F.struct("version", "generation")).alias("h")).first()
    return (row.h.version, row.h.generation) if row.h is not None else None


def last_batch(spark: SparkSession, path: str) -> int | None:
    """Number of the last batch of a stream that was committed, None where there is none."""
    if not _exists(spark, f"{path}/head"):
        return None
    return read_stored(spark, f"{path}/head", S.HEAD).agg(F.max("batch")).first()[0]


def _commit_chunks(chunks: DataFrame, kbs: DataFrame, path: str, append: bool = False, batch: int | None = None) -> None:
    """``_commit_index`` of chunks whose texts are dealt by key ranges, which is far less to shuffle than their postings."""
    lengths = doc_stats(chunks.select("kb_id", "chunk_key", "content").repartitionByRange("kb_id", "chunk_key"))
    post, blocks = postings_and_records(chunks)
    _commit_index(post, lengths, kbs, path, append, batch, blocks, ranged=True)


def _commit_index(post: DataFrame, stats: DataFrame, kbs: DataFrame, path: str, append: bool = False, batch: int | None = None, blocks: DataFrame | None = None, ranged: bool = False) -> None:
    """Write collections ``kbs`` as a new generation of all tables, then publish it.

    Nothing that a reader uses is overwritten: each table gets a folder for the generation, and ``collections`` says for every
    collection which generations hold it: this one alone, or with ``append`` this one and those before. The commit is one row in one file of ``head``; a writer that breaks off before leaves the
    last version as it was. Two writers at a time are not told apart: run one. ``ranged`` says that ``post`` and ``stats`` are
    dealt by key ranges already. Where no ``blocks`` are given, they are made of the stored postings.
    """
    spark = post.sparkSession
    last = index_version(spark, path)
    generation = uuid.uuid4().hex

    def write(df: DataFrame, table: str, schema: str) -> DataFrame:
        _write_table(S.conform(df, schema), f"{path}/{table}/generation={generation}")
        return read_stored(spark, f"{path}/{table}/generation={generation}", schema)

    dealt = (lambda df: df.repartitionByRange("kb_id", "chunk_key")) if not ranged else (lambda df: df)
    stored = write(dealt(post).sortWithinPartitions("kb_id", "chunk_key"), "postings", S.POSTINGS)
    lengths = write(dealt(stats).sortWithinPartitions("kb_id", "chunk_key"), "doc_stats", S.DOC_STATS)
    write(term_stats(stored).repartitionByRange("kb_id", "term").sortWithinPartitions("kb_id", "term"), "terms", S.TERMS)
    write(corpus_stats(lengths), "corpus", S.CORPUS)
    write(blocked(stored) if blocks is None else blocks, "blocks", RECORDS)
    now = kbs.select("kb_id", F.lit(generation).alias("generation"))
    if last is not None:
        old = read_stored(spark, f"{path}/collections/commit={last[1]}", S.COLLECTIONS)
        now = now.unionByName(old if append else old.join(kbs, "kb_id", "left_anti"))
    now.write.parquet(f"{path}/collections/commit={generation}")
    head = spark.createDataFrame([((last[0] if last else 0) + 1, generation, batch)], S.HEAD)
    head.coalesce(1).write.mode("append").parquet(f"{path}/head")


def _write_table(df: DataFrame, path: str) -> None:
    df.write.partitionBy("kb_id").parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(kb_id, generation) of the last version."""
    _, commit = index_version(spark, path)
    return read_stored(spark, f"{path}/collections/commit={commit}", S.COLLECTIONS)


@dataclass(frozen=True)
class _Version:
    """The last version of a stored index: which generations hold a collection, looked up once for all its tables."""

    path: str
    collections: DataFrame
    used: list[str]  # one per commit still in use
    small: bool
    segmented: bool

    def live(self, table: str, schema: str) -> DataFrame:
        """Rows of a table, of all segments."""
        spark = self.collections.sparkSession
        rows = read_stored(spark, f"{self.path}/{table}", f"{schema}, generation string").filter(F.col("generation").isin(self.used))
        if len(self.used) > 1:
            rows = bounded_join(rows, self.collections, ["kb_id", "generation"], "left_semi", small_is_small=self.small or None)
        return rows.drop("generation")


def _last_version(spark: SparkSession, path: str) -> _Version:
    collections = _segments(spark, path)
    total = collections.agg(
        F.collect_set("generation").alias("used"), F.count("*").alias("n"), F.count_distinct("kb_id").alias("kbs"),
        F.count_if(F.col("kb_id").isNull()).alias("nameless"), F.sum(F.coalesce(F.octet_length("kb_id"), F.lit(0)) + 64).alias("size"),
    ).first()
    segmented = total.n - total.nameless > total.kbs or total.nameless > 1
    return _Version(path, collections, sorted(total.used), within_bounds(total.n, total["size"] or 0), segmented)


def read_bm25_index(spark: SparkSession, path: str) -> Bm25Index:
    """The last version of the stored index; statistics are stored too and not derived again, but for sums over the segments of
    a collection where one has several."""
    version = _last_version(spark, path)
    live = version.live
    corpus, terms, parts = live("corpus", S.CORPUS), live("terms", S.TERMS), None
    if version.segmented:
        corpus, terms, parts = merged_corpus(corpus), merged_terms(terms), terms
    return Bm25Index(live("postings", S.POSTINGS), corpus, terms, corpus.select("kb_id"), live("blocks", RECORDS), parts)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path``; only a missing path counts as none, every other failure is raised."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018 - resolves the path
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so the rows may replace the table they were read from."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def _replace_partitions(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str]) -> None:
    """Overwrite just the partitions present in ``df``; ``order`` range-partitions and sorts the files."""
    if order:
        df = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


# --- deletion ---------------------------------------------------------------------------------------------------
def delete_from_index(index: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted count per collection) for targets(kb_id[, doc_id][, chunk_key]); all given columns must
    match, so document and keys together delete their intersection."""
    keys = [c for c in ("kb_id", "doc_id", "chunk_key") if c in targets.columns]
    wanted = targets.select(*keys).distinct()
    gone = bounded_join(index, wanted, keys, "left_semi").groupBy("kb_id").agg(F.count("*").alias("deleted"))
    return bounded_join(index, wanted, keys, "left_anti"), gone


@dataclass(frozen=True)
class Tables:
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    doc_stats: DataFrame


def remove_documents(tables: Tables, doc_ids: DataFrame, now: str) -> Tables:
    """Tables after removing doc_ids(doc_id): chunk rows, vectors and postings go, the document stays as deleted with
    no chunks. Index rows are found through the chunk keys, so only the collections concerned change."""
    ids = doc_ids.select("doc_id").distinct()
    keys = bounded_join(tables.chunks, ids, ["doc_id"], "left_semi").select("kb_id", "chunk_key")
    flag = ids.withColumn("_gone", F.lit(True))
    docs = bounded_join(tables.documents, flag, ["doc_id"], "left")
    gone = F.coalesce("_gone", F.lit(False))
    docs = docs.withColumns({
        "deleted_at": F.when(gone, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("deleted_at").cast("timestamp_ntz")),
        "chunk_count": F.when(gone, F.lit(0).cast("long")).otherwise(F.col("chunk_count")),
    }).drop("_gone")

    def without(df: DataFrame) -> DataFrame:
        return df.join(keys, ["kb_id", "chunk_key"], "left_anti")

    kept = bounded_join(tables.chunks, ids, ["doc_id"], "left_anti")
    return Tables(docs, kept, without(tables.vectors), without(tables.postings), without(tables.doc_stats))


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of live documents, for rebuilding an index; order by (doc_id, chunk_index) where rows are listed."""
    return chunks.join(live(documents).select("doc_id", "doc_name"), "doc_id")


# --- ingest bookkeeping -----------------------------------------------------------------------------------------
def ingest_report(documents: DataFrame, chunks: DataFrame, rejects: DataFrame, parser: str = "text") -> DataFrame:
    """Status per document. A document without chunks is FAILED, with the reader's reason when there is one; chunk
    characters count overlaps twice, so the text's own length is kept beside them."""
    totals = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.sum("char_count").alias("char_count"), F.sum("token_count").alias("token_count")
    )
    reasons = rejects.groupBy("doc_id").agg(F.min("reason").alias("_reason"))
    joined = documents.select("doc_id", "kb_id", "text").join(totals, "doc_id", "left").join(reasons, "doc_id", "left")
    failed = F.col("chunk_count").isNull()
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "kb_id", F.when(~failed, parser).alias("parser"), F.lit(1).alias("page_count"),
        F.char_length("text").cast("long").alias("text_chars"), F.coalesce("char_count", zero).alias("char_count"),
        F.coalesce("chunk_count", zero).alias("chunk_count"), F.coalesce("token_count", zero).alias("token_count"),
        F.when(failed, "FAILED").otherwise("READY").alias("status"),
        F.when(failed, F.when(F.col("_reason").isNotNull(), "REJECTED").otherwise("EMPTY")).alias("error_code"),
        F.left(F.when(failed, F.coalesce("_reason", F.lit("no chunk produced"))), F.lit(1000)).alias("error_message"),
    )


def content_hash(col: str = "text") -> Column:
    return F.sha2(F.col(col), 256)


def duplicates(documents: DataFrame) -> DataFrame:
    """Live documents whose (collection, hash) an earlier document already has, with that document's id.

    The first id per hash comes from a combine, not a window, so a group of copies of any size is never sorted in
    one task.
    """
    first = live(documents).groupBy("kb_id", "sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    copies = bounded_join(live(documents), first, ["kb_id", "sha256"], spread=["doc_id"])
    return copies.filter("doc_id > first_id").select("kb_id", "doc_id", "sha256", "first_id")


def new_only(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Incoming documents whose (collection, hash) is not stored yet, one per hash within the batch."""
    fields = [c for c in incoming.columns if c not in ("kb_id", "sha256")]
    once = incoming.groupBy("kb_id", "sha256").agg(F.min_by(F.struct(*fields), "doc_id").alias("r")).select("kb_id", "sha256", "r.*")
    return once.join(live(documents).select("kb_id", "sha256"), ["kb_id", "sha256"], "left_anti")


# --- consistency and statistics ---------------------------------------------------------------------------------
def consistency(chunks: DataFrame, vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """Counts of the three stores per collection and whether they hold the same keys, from one combine by key."""
    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select("kb_id", "chunk_key", *[F.lit(int(n == name)).alias(n) for n in ("c", "v", "b")])

    every = tag(chunks, "c").unionByName(tag(vectors, "v")).unionByName(tag(stats, "b"))
    per_key = every.groupBy("kb_id", "chunk_key").agg(*[F.max(n).alias(n) for n in ("c", "v", "b")])
    return per_key.groupBy("kb_id").agg(
        F.sum("c").alias("chunks"), F.sum("v").alias("vectors"), F.sum("b").alias("indexed"),
        F.count_if(F.col("c") + F.col("v") + F.col("b") < 3).alias("different_keys"),
    ).withColumn("consistent", F.col("different_keys") == 0)


def missing_keys(chunks: DataFrame, store: DataFrame) -> DataFrame:
    keys = ["kb_id", "chunk_key"]
    return chunks.select(*keys).join(store.select(*keys), keys, "left_anti")


def doc_counts(kbs: DataFrame, documents: DataFrame) -> DataFrame:
    counts = live(documents).groupBy("kb_id").agg(F.count("*").alias("documents"))
    return kbs.select("kb_id").join(counts, "kb_id", "left").na.fill(0, ["documents"])


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return live(documents).select("kb_id", "doc_id").join(counts, "doc_id", "left").na.fill(0, ["chunks"])


def kb_stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """Numbers per collection and a total row (kb_id NULL). Each source is combined per collection before the join."""
    by_status = [F.count_if(F.col("status") == s).alias(f"docs_{s.lower()}") for s in STATUSES]
    d = live(documents).groupBy("kb_id").agg(F.count("*").alias("documents"), *by_status)
    c = chunks.groupBy("kb_id").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"), F.sum("token_count").alias("tokens"))
    v = vectors.groupBy("kb_id").agg(F.count("*").alias("vectors"))
    b = stats.groupBy("kb_id").agg(F.count("*").alias("indexed"))
    joined = d.join(c, "kb_id", "full_outer").join(v, "kb_id", "full_outer").join(b, "kb_id", "full_outer")
    names = [n for n in joined.columns if n != "kb_id"]
    return joined.na.fill(0, names).rollup("kb_id").agg(*[F.sum(n).alias(n) for n in names])


# --- listings ---------------------------------------------------------------------------------------------------
def paginate(df: DataFrame, order: Sequence[Column], page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, total). Shallow pages only: offset rows are read; use ``after`` for deep ones."""
    page, size = max(int(page), 1), max(int(size), 1)
    return df.orderBy(*order).offset((page - 1) * size).limit(size), df.agg(F.count("*").alias("total"))


def after(df: DataFrame, key: str, last: int | None, size: int) -> DataFrame:
    """Next page behind the last seen key in descending order; the predicate reaches the scan."""
    rows = df if last is None else df.filter(F.col(key) < last)
    return rows.orderBy(F.desc(key)).limit(size)


def list_documents(documents: DataFrame, chunks: DataFrame, keyword: str | None = None, limit: int = 50) -> DataFrame:
    """Newest documents with status and chunk count; counts are taken for the listed ones only."""
    newest = search_name(live(documents), ["doc_name"], keyword).orderBy(F.desc("doc_id")).limit(limit)
    wanted = newest.select("doc_id", "doc_name", "status")
    counts = chunks.select("doc_id").join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi")  # at most ``limit`` rows
    counts = counts.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return wanted.join(counts, "doc_id", "left").na.fill(0, ["chunks"])


# --- sinks ------------------------------------------------------------------------------------------------------
def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def to_prometheus(stats: DataFrame, help_texts: dict[str, str], by_mode: DataFrame | None = None, prefix: str = "qa") -> DataFrame:
    """Gauge lines (ord, line) of a one-row statistics frame, then one labelled line per mode for requests and cost."""
    names = [c for c in stats.columns if c in help_texts]
    values = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("metric"), F.lit(help_texts[n]).alias("help"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value"), F.lit("").alias("label")) for i, n in enumerate(names)]
    rows = stats.select(F.inline(F.array(*values)))
    if by_mode is not None:
        label = F.concat(F.lit('{mode="'), "mode", F.lit('"}'))
        extra = [("requests_by_mode", "requests", "requests per mode"), ("cost_usd_by_mode", "cost_usd", "cost per mode in USD")]
        cells = [F.struct(F.lit(1000 + i).alias("ord"), F.lit(m).alias("metric"), F.lit(h).alias("help"), F.col(c).cast("double").alias("value"), label.alias("label")) for i, (m, c, h) in enumerate(extra)]
        rows = rows.unionByName(by_mode.select(F.inline(F.array(*cells))))
    name = F.concat(F.lit(f"{prefix}_"), "metric")
    safe = F.replace(F.replace(F.col("help"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit(" "))
    lines = F.array(
        F.concat(F.lit("# HELP "), name, F.lit(" "), safe), F.concat(F.lit("# TYPE "), name, F.lit(" gauge")),
        F.concat(name, "label", F.lit(" "), F.col("value").cast("decimal(38,6)").cast("string")),
    )
    return rows.select("ord", "label", F.posexplode(lines).alias("part", "line")).select("ord", "label", "part", "line")


def conform_chunks(chunks: DataFrame) -> DataFrame:
    return S.conform(chunks, S.CHUNKS, ("kb_id", "chunk_key", "doc_id", "chunk_index", "content"))

