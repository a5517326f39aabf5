"""Question answering in batch: several queries per question, merged candidates, grading, an extractive answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from answerloom.functions import text as T
from answerloom.operators import fusion as R
from answerloom.plans.search import Corpus, SearchConfig, hybrid_search

# --- fixed values -----------------------------------------------------------------------------------------------
MIN_COVERAGE = 0.25
MIN_SENTENCE, MIN_CHECKED = 6, 12
REFUSAL_ANSWER = (
    "知识库中没有找到与该问题相关的内容，因此我无法给出有依据的回答。" "建议换一种问法，或确认相关文档已经上传。"
)
# ----------------------------------------------------------------------------------------------------------------


def expand_queries(questions: DataFrame) -> DataFrame:
    """questions(question_id, question[, rewrites]) to one row per cleaned query; ids count up within a question."""
    raw = F.col("rewrites") if "rewrites" in questions.columns else F.array("question")
    return questions.select("question_id", F.posexplode(R.normalize_queries(raw, F.col("question"))).alias("pos", "q")).select(
        "question_id", F.concat_ws("#", F.col("question_id").cast("string"), F.col("pos").cast("string")).alias("query_id"), F.col("q").alias("question")
    )


def extractive_answer(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Answer from the context that covers the question best: its two best sentences in text order with the citation.

    contexts(question_id, rank, text, source), at most a handful per question. Below the coverage minimum, or without
    contexts, the answer is the refusal. Without a matching sentence the first 200 characters stand in.
    """
    q = questions.select("question_id", "question", T.tokenize("question").alias("qt"))
    scored = contexts.join(q.select("question_id", "qt"), "question_id")
    scored = scored.withColumn("cov", T.coverage_of(F.col("qt"), T.tokenize("text")))
    best = scored.groupBy("question_id").agg(F.max_by(F.struct("rank", "text", "source", "cov", "qt"), F.struct("cov", -F.col("rank"))).alias("b"))
    sentence = F.transform(T.sentences(T.trim_ws("b.text")), T.trim_ws)
    cut = F.filter(F.transform(sentence, lambda s, i: F.struct(i.alias("pos"), s.alias("s"))), lambda x: F.char_length(x.s) >= MIN_SENTENCE)
    graded = F.filter(
        F.transform(cut, lambda x: F.struct((-F.floor(T.coverage_of(F.col("b.qt"), T.tokenize(x.s)) * 1000)).alias("neg"), T.coverage_of(F.col("b.qt"), T.tokenize(x.s)).alias("c"), x.pos.alias("pos"), x.s.alias("s"))),
        lambda x: x.c > 0,
    )
    by_score = F.array_sort(F.transform(graded, lambda x: F.struct(x.neg, x.pos, x.s)))
    top = F.slice(F.transform(by_score, lambda x: F.struct(x.pos, x.s)), 1, 2)
    picked = F.array_join(F.transform(F.array_sort(top), lambda x: x.s), " ")
    body = F.when(picked != "", picked).otherwise(T.trim_ws(F.left("b.text", F.lit(200))))
    text = F.concat(body, F.lit(" ["), F.col("b.rank").cast("string"), F.lit("]"), F.when(F.col("b.source") != "", F.concat(F.lit("（出自 "), "b.source", F.lit("）"))).otherwise(""))
    refuse = F.col("b").isNull() | (F.col("b.cov") < MIN_COVERAGE)
    return questions.select("question_id").join(best, "question_id", "left").select(
        "question_id", F.when(refuse, F.lit(REFUSAL_ANSWER)).otherwise(text).alias("answer"),
        F.when(~refuse, F.col("b.rank")).alias("cited_rank"), refuse.alias("refused"),
    )


def unsupported_sentences(answers: DataFrame) -> DataFrame:
    """Sentences of 12 and more characters without a citation, per answer; the answer passes when there is none."""
    sentence = F.transform(T.sentences(F.coalesce("answer", F.lit(""))), T.trim_ws)
    bare = F.filter(sentence, lambda s: (F.char_length(s) >= MIN_CHECKED) & ~s.rlike(T.CITATION))
    return answers.withColumn("unsupported", bare).withColumn("passed", F.size("unsupported") == 0)


def answer_batch(questions: DataFrame, corpus: Corpus, embed, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """questions(question_id, question[, rewrites][, kb_ids]) to answers with refusal flag, sources and gate.

    ``embed`` turns the query column into a vector column. The model-driven rewrite and reflect loops are left out;
    rewrites made elsewhere come in as an array column.
    """
    queries = expand_queries(questions).withColumn("embedding", embed(F.col("question")))
    if "kb_ids" in questions.columns:
        queries = queries.join(questions.select("question_id", "kb_ids"), "question_id")
    result = hybrid_search(queries.drop("question_id"), corpus, cfg)
    of_question = queries.select("query_id", "question_id")
    hits = result.hits.join(of_question, "query_id")
    merged = R.merge_candidates(hits, 3 * cfg.top_k)
    graded = R.grade(merged, cfg.vector_min_score, cfg.keyword_min_coverage)
    chosen = R.select_contexts(graded)
    label = T.source_label(F.col("doc_name"), F.col("doc_id"), F.col("section_path"), F.col("page_no"))
    contexts = chosen.select("question_id", "rank", "chunk_key", F.col("context_text").alias("text"), label.alias("source"))
    answers = extractive_answer(questions, contexts)
    cited = F.array_sort(F.collect_list(F.struct("rank", "chunk_key", "source")))
    sources = contexts.groupBy("question_id").agg(cited.alias("sources"))
    return answers.join(sources, "question_id", "left").withColumn("refusal", T.is_refusal("answer"))

