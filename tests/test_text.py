from pyspark.sql import functions as F

from answerloom.functions import text as T


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()[0]


def test_index_tokens_of_mixed_text(spark):
    got = one(spark, T.tokenize("t"), t="一线城市 PAYLOAD_TOO_LARGE the 税")
    assert sorted(got) == sorted(["线", "城", "市", "一线", "线城", "城市", "税", "payload", "too", "large"])


def test_pairs_never_cross_punctuation(spark):
    assert "销标" not in one(spark, T.tokenize("t"), t="报销，标准")


def test_stopwords_only_and_punctuation_only_give_nothing(spark):
    assert one(spark, T.tokenize("t"), t="the of 的 了") == []
    assert one(spark, T.tokenize("t"), t="!!! ...") == []
    assert one(spark, T.tokenize("t"), t=None) == []


def test_invisible_characters_do_not_split_words(spark):
    assert one(spark, T.tokenize("t"), t="wo​rd") == ["word"]


def test_eval_tokens_keep_single_characters(spark):
    assert one(spark, T.tokenize_eval("t"), t="税 报销单 is") == ["税", "报销", "销单", "is"]


def test_coverage_without_signal_is_zero(spark):
    assert one(spark, T.coverage("q", "t"), q="!!!", t="word") == 0.0
    assert one(spark, T.coverage("q", "t"), q="word", t="!!!") == 0.0
    assert one(spark, T.coverage("q", "t"), q="red red blue", t="blue sky") == 0.5


def test_token_estimate(spark):
    assert one(spark, T.estimate_tokens("t"), t="") == 0
    assert one(spark, T.estimate_tokens("t"), t="hello world") == 3
    assert one(spark, T.estimate_tokens("t"), t="住宿ab") == 3


def test_match_keys(spark):
    assert one(spark, T.doc_keys("t"), t="  Guide　 One.MD ") == ["doc:guide one.md", "doc:guide one"]
    assert one(spark, T.section_keys("t"), t="Guide > Costs") == ["section:guide > costs", "section:costs"]
    assert one(spark, T.section_keys("t"), t=" ") == []


def test_citations_respect_valid_ranks(spark):
    valid = F.array(F.lit(1), F.lit(2))
    assert one(spark, T.citation_ranks("t", valid), t="a [1] b [2024] c [2][0]") == [1, 2]
    assert one(spark, T.citation_ranks("t"), t="a [1] b [2024]") == [1, 2024]


def test_refusal_needs_marker_and_short_text(spark):
    marker = T.REFUSAL_MARKERS[0]
    assert one(spark, T.is_refusal("t"), t=f" {marker} ") is True
    assert one(spark, T.is_refusal("t"), t=marker + "x" * 200) is False
    assert one(spark, T.is_refusal("t"), t="fine") is False


def test_document_normalising_order(spark):
    assert one(spark, T.normalize_document("t"), t="a\r\nb\rc\n​\n\n\nd  \n ") == "a\nb\nc\n\nd"
    assert one(spark, T.line_count("t"), t="a\nb\n") == 3


def test_source_label_skips_missing_parts(spark):
    df = spark.createDataFrame([(7, None, "s", 2), (8, "d.md", None, None)], "id long, name string, sec string, page int")
    labels = [r[0] for r in df.select(T.source_label(F.col("name"), F.col("id"), F.col("sec"), F.col("page"))).collect()]
    assert labels == ["文档7 > s > 第2页", "d.md"]
