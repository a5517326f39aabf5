"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import text as T
from answerloom.registry import query
from answerloom.registry.fixtures import coverage_sql, doc_chunks, questions, table, tokens_sql

_ACCENTS = "ñ"


@query(
    "token_norm",
    "SELECT doc_id, md5(lower(text)) AS norm_md5, length(lower(text)) AS norm_len FROM documents",
)
def token_norm(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.norm("text")).alias("norm_md5"), F.char_length(T.norm("text")).cast("long").alias("norm_len"))


@query(
    "index_tokens",
    f"""SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, md5(array_to_string({tokens_sql('text')}, ' ')) AS token_md5
        FROM documents""",
)
def index_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return d.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_md5")
    )


@query(
    "query_term_list",
    f"""SELECT item_id, array_to_string(list_transform(list_filter(list_zip(t, range(len(t))),
              lambda p: list_position(t, p[1]) = p[2] + 1), lambda p: p[1]), ' ') AS terms
        FROM (SELECT item_id, {tokens_sql('text')} AS t FROM benchmark)""",
)
def query_term_list(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.array_join(T.query_terms("text"), " ").alias("terms"))


@query(
    "term_coverage",
    f"""WITH u AS (SELECT conv_id, text AS q FROM conversations WHERE turn = 0),
             a AS (SELECT conv_id, turn, text AS t FROM conversations WHERE turn > 0),
             z AS (SELECT conv_id, turn, {tokens_sql('q')} AS qt, {tokens_sql('t')} AS tt FROM u JOIN a USING (conv_id))
        SELECT conv_id, turn, round({coverage_sql('qt', 'tt')}, 6) AS coverage FROM z""",
)
def term_coverage(spark, sf):
    c = table(spark, sf, "conversations")
    first = c.filter("turn = 0").select("conv_id", T.tokenize("text").alias("qt"))
    rest = c.filter("turn > 0").select("conv_id", "turn", T.tokenize("text").alias("tt"))
    return rest.join(first, "conv_id").select(
        "conv_id", "turn", F.round(T.coverage_of(F.col("qt"), F.col("tt")), 6).alias("coverage")
    )


@query(
    "eval_tokens",
    f"""SELECT doc_id, len({tokens_sql('text', False)}) AS n_tokens,
               md5(array_to_string({tokens_sql('text', False)}, ' ')) AS token_md5 FROM documents""",
)
def eval_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_eval("text").alias("t"))
    return d.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_md5")
    )


@query(
    "eval_coverage",
    f"""WITH u AS (SELECT conv_id, text AS q FROM conversations WHERE turn = 0),
             a AS (SELECT conv_id, turn, text AS t FROM conversations WHERE turn > 0),
             z AS (SELECT conv_id, turn, {tokens_sql('q', False)} AS qt, {tokens_sql('t', False)} AS tt
                   FROM u JOIN a USING (conv_id))
        SELECT conv_id, turn, round({coverage_sql('qt', 'tt')}, 6) AS coverage FROM z""",
)
def eval_coverage(spark, sf):
    c = table(spark, sf, "conversations")
    first = c.filter("turn = 0").select("conv_id", T.tokenize_eval("text").alias("qt"))
    rest = c.filter("turn > 0").select("conv_id", "turn", T.tokenize_eval("text").alias("tt"))
    return rest.join(first, "conv_id").select(
        "conv_id", "turn", F.round(T.coverage_of(F.col("qt"), F.col("tt")), 6).alias("coverage")
    )


@query("token_estimate", "SELECT doc_id, ceil(length(text) / 4.0)::INT AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query(
    "token_budget",
    """SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, sum(ceil(length(text) / 4.0)) <= 30000 AS fits
       FROM documents GROUP BY source""",
)
def token_budget(spark, sf):
    from answerloom.operators.usage import fits_budget

    return fits_budget(table(spark, sf, "documents"), ["source"], 30000)


@query(
    "sentence_split",
    """SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS pos, md5(unnest(s)) AS sentence_md5
       FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?\\n]+[。！？!?]?') AS s FROM documents)""",
)
def sentence_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "s"))
    return d.select("doc_id", "pos", F.md5("s").alias("sentence_md5"))


@query(
    "citation_markers",
    """WITH a AS (SELECT doc_id, text || ' [' || doc_id % 7 || '] and [' || (doc_id + 2020) || '][' || doc_id % 3 || ']' AS t
                  FROM documents)
       SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1),
              lambda x: x::INT), lambda x: x IN (1, 2, 3, 4, 5)), ',') AS ranks FROM a""",
)
def citation_markers(spark, sf):
    d = table(spark, sf, "documents")
    answer = F.concat(
        "text", F.lit(" ["), (F.col("doc_id") % 7).cast("string"), F.lit("] and ["), (F.col("doc_id") + 2020).cast("string"),
        F.lit("]["), (F.col("doc_id") % 3).cast("string"), F.lit("]"),
    )
    valid = F.array(*[F.lit(i) for i in range(1, 6)])
    return d.select("doc_id", F.array_join(T.citation_ranks(answer, valid).cast("array<string>"), ",").alias("ranks"))


@query(
    "match_keys",
    r"""SELECT c_custkey, 'doc:' || lower(trim(regexp_replace('  ' || c_name || '.V1.TXT ', '\s+', ' ', 'g'))) || ',doc:'
                || lower(trim(regexp_replace('  ' || c_name || '.V1', '\s+', ' ', 'g'))) AS doc_keys,
              'section:' || lower(c_mktsegment) || ' > ' || lower(c_name) || ',section:' || lower(c_name) AS section_keys
       FROM customer""",
)
def match_keys(spark, sf):
    c = table(spark, sf, "customer")
    doc = F.concat(F.lit("  "), "c_name", F.lit(".V1.TXT "))
    section = F.concat("c_mktsegment", F.lit("  >  "), "c_name")
    return c.select(
        "c_custkey",
        F.array_join(T.doc_keys(doc), ",").alias("doc_keys"),
        F.array_join(T.section_keys(section), ",").alias("section_keys"),
    )


@query(
    "refusal_flag",
    """WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ' 知识库中没有 ' || text ELSE text END AS t FROM conversations)
       SELECT conv_id, turn, length(trim(t, E' \\t\\n\\r')) BETWEEN 1 AND 200 AND contains(t, '知识库中没有') AS refusal FROM a""",
)
def refusal_flag(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" 知识库中没有 "), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.is_refusal(t).alias("refusal"))


@query(
    "hit_labels",
    r"""SELECT doc_id, 'doc_' || doc_id || '.txt > ' || lang AS label,
               CASE WHEN length(s) > 200 THEN left(s, 200) || '…' ELSE s END AS snippet
        FROM (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)""",
)
def hit_labels(spark, sf):
    c = doc_chunks(spark, sf)
    label = T.source_label(F.format_string("doc_%d.txt", "doc_id"), F.col("doc_id"), F.col("section_path"), F.col("page_no"))
    return c.select("doc_id", label.alias("label"), T.snippet("content").alias("snippet"))
