"""Registered queries of the pipeline operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom.llm import cleaning
from answerloom.llm.common import table
from answerloom.llm.curriculum import mixed
from answerloom.llm.decontaminate import contaminated
from answerloom.llm.html import main_texts
from answerloom.llm.langid import languages
from answerloom.llm.maxscore import build_index, search
from answerloom.llm.negatives import hard_negatives
from answerloom.llm.oddsketch import near_duplicates
from answerloom.llm.pii import report
from answerloom.llm.runindex import repeated_bytes
from answerloom.llm.secrets import scan
from answerloom.llm.setjoin import joined
from answerloom.llm.toxicity import scored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_LINES = f"""list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"""
_WORDS = "regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"
_CHARS = "length(regexp_replace({x}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
_TRIM = "regexp_replace(x, '[\\x20\\x09-\\x0D]+$', '')"
_CONTAINS = "len(list_filter([{bars}], lambda b: contains({x}, b))) > 0"
_any = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"

ORACLES["op6_line_first"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, text, {_WORDS.format(x="text")} AS ws, {_LINES} AS ls FROM d),
  g AS (SELECT doc_id, i, ws[i:i + 4] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
  t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
  c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
  l AS (SELECT *, list_filter(ls, lambda x: NOT (({_CONTAINS.format(x="x", bars=_any(cleaning.BARS))} AND regexp_matches(x, {_quoted(cleaning.BARRED)}))
          OR (length(x) <= {cleaning.NAVIGATION_CHARS} AND regexp_matches(x, {_quoted(cleaning.NAVIGATION)})) OR {_CONTAINS.format(x="x", bars=_any(cleaning.FORMS))}
          OR (len({_WORDS.format(x="x")}) > {cleaning.SHORT_LINE} AND NOT regexp_matches(right({_TRIM}, 16), {_quoted(cleaning.STOP)})))) AS good FROM w),
  m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, {_CHARS.format(x="text")}::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
          (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, (len(ls) - len(good))::BIGINT AS n_lines_removed,
          array_to_string(good, chr(10)) AS clean FROM l LEFT JOIN c USING (doc_id)),
  f AS (SELECT *, {_CHARS.format(x="clean")}::BIGINT AS clean_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, len({_WORDS.format(x="clean")}) AS left_words FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * (word_chars - clean_chars) <= {cleaning.MOST_LOST} * word_chars AND left_words >= {cleaning.LEAST_WORDS} AS kept, n_lines_removed, clean_chars FROM f"""

ORACLES["op9_curriculum"] = f"""WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format(x="text")}), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS place FROM s),
  w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CASE place % 3 WHEN 0 THEN -0.6::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS slope,
          (2 * source_size)::DOUBLE AS cap FROM p),
  r AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 150 / 100 AS total, sum(weight) OVER () AS all_weight,
          sum(cap) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS UNBOUNDED PRECEDING) - cap AS capped_before,
          sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS UNBOUNDED PRECEDING) AS weight_to FROM w),
  v AS (SELECT *, (total - capped_before) / (all_weight - weight_to + weight)::DOUBLE AS level FROM r),
  k AS (SELECT level FROM v WHERE level * weight < cap ORDER BY source_size::DOUBLE / weight, place LIMIT 1),
  g AS (SELECT source, source_size, slope, CASE WHEN level * weight >= cap THEN cap ELSE coalesce((SELECT level FROM k), 0) * weight END AS target FROM v),
  o AS (SELECT doc_id, size, source_size, target, slope, floor(target)::BIGINT AS goal,
          (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS first FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
  a AS (SELECT *, least(greatest(goal - first, 0), size) AS once, least(greatest(goal - first - source_size, 0), size) AS twice FROM o)
  SELECT doc_id, size, source_size, target, (once + twice)::BIGINT AS taken, round(CASE WHEN once > 0 THEN CASE WHEN slope = 0 THEN first / target
    ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * (first / target), 0.0)) - (1 - slope)) / (2 * slope) END END, 9) AS position FROM a"""

ORACLES["op12_packed_products"] = """WITH d AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS e FROM embeddings),
  v AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x::DOUBLE)) AS c FROM d
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
  n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
  SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op13_block_max"] = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS ts FROM documents),
  f AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
  g AS (SELECT count(*)::BIGINT AS total_docs, sum(n)::BIGINT AS total_terms FROM f),
  q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
  o AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM f) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
  w AS (SELECT t, floor(1000 * ln((2 * total_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM o, g GROUP BY t, total_docs),
  i AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total_docs) // total_terms))) AS gain FROM o JOIN w USING (t), g),
  s AS (SELECT item_id, doc_id, sum(times * gain)::BIGINT AS score FROM q JOIN i USING (t) GROUP BY ALL HAVING sum(times * gain) > 0),
  r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
  SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10"""


def _linked(percent: int, columns: str) -> str:
    """Components of documents by shingle sets: every pair that shares a shingle is counted."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(x=_FOLDED)} AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
  z AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  h AS (SELECT x, y FROM p JOIN z u ON u.doc_id = x JOIN z v ON v.doc_id = y WHERE 100 * i >= {percent} * (u.n + v.n - i)),
  l AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h),
  r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.y, r.other FROM r JOIN l ON l.x = r.doc_id),
  c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, {columns} FROM c LEFT JOIN z USING (doc_id)"""


ORACLES["op3_odd_sketches"] = _linked(85, "component_id, doc_id = component_id AS kept")
ORACLES["op11_set_relations"] = _linked(80, "component_id")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


@query
def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op3_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_toxic_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@query
def op6_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.judged(table(spark, sf_dir, "documents"))


@query
def op7_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@query
def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).withColumn("position", F.round("position", 9))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


@query
def op11_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


@query
def op12_packed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id is divisible by 7 the label moves on by one, modulo 10, as the mining is defined."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


@query
def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
