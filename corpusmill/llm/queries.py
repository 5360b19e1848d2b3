"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import crosssplit, encoding, language, leakage, mixing, neardup, reading, splits, templates
from corpusmill.operators.components import connected_components
from corpusmill.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of articles with similarity of at least 0.5 on word triples."""
    pairs = neardup.near_duplicate_pairs(table(spark, d, "cleaned_articles"), "row_seq", "article_text", 0.5, 3)
    return pairs.records().select(F.col("a").alias("row_seq_a"), F.col("b").alias("row_seq_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per article: its class of equal texts, the links of the class and the group it belongs to."""
    pairs = neardup.near_duplicate_pairs(table(spark, d, "cleaned_articles"), "row_seq", "article_text", 0.5, 3)
    groups = connected_components(pairs.edges(), "a", "b").toDF("class_id", "g")
    return (
        pairs.classes()
        .join(groups, "class_id", "left")
        .select(F.col("id").alias("row_seq"), "class_id", "class_size", "links", F.coalesce("g", "class_id").alias("group_id"))
    )


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap(table(spark, d, "human_benchmark_split"), table(spark, d, "silver"), "bench_row_id", "silver_row_id", threshold=0.5, width=3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark and silver rows with the same uri or texts of similarity of at least 0.5 on word triples."""
    return _overlap(spark, d).select(F.col("eval_id").alias("bench_row_id"), F.col("train_id").alias("silver_row_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by evaluation split and source."""
    bench, silver = table(spark, d, "human_benchmark_split"), table(spark, d, "silver")
    return crosssplit.report(_overlap(spark, d), bench, silver, "bench_row_id", "silver_row_id", "evaluation_split", "source_uri")


def _labelled(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    a, t = table(spark, d, "cleaned_articles"), table(spark, d, "documents")
    return {
        "cleaned_articles": a.select(F.col("row_seq").alias("row_key"), language.country_language("country").alias("label"), F.col("article_text").alias("text")),
        "documents": t.select(F.col("doc_id").alias("row_key"), language.code("lang").alias("label"), "text"),
    }


def _languages(spark: SparkSession, d: str):
    t = _labelled(spark, d)
    return t, *language.fit_both(list(t.values()))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of passages of at least 15 words that are not the labelled one."""
    t, model, channel = _languages(spark, d)
    parts = [language.unlabelled(x, "row_key", "text", "label", model, channel).select(F.lit(n).alias("tbl"), "row_key", "lang") for n, x in t.items()]
    return parts[0].union(parts[1])


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its languages and passages, each with a confidence."""
    t, model, channel = _languages(spark, d)
    parts = [language.infer(x, "row_key", "text", model, channel).select(F.lit(n).alias("tbl"), "*") for n, x in t.items()]
    return parts[0].union(parts[1])


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _texts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "raw_news": table(spark, d, "raw_news").select("row_seq", F.col("body").alias("text")),
        "cleaned_articles": table(spark, d, "cleaned_articles").select("row_seq", F.col("article_text").alias("text")),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text has characters garbled by a wrong encoding."""
    t = _texts(spark, d)
    model = encoding.fit(t["raw_news"].union(t["cleaned_articles"]), "text")
    parts = [encoding.garbled_rows(x, "row_seq", "text", model).select(F.lit(n).alias("tbl"), "row_seq") for n, x in t.items()]
    return parts[0].union(parts[1])


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every text, restored where that is possible."""
    t = _texts(spark, d)
    model = encoding.fit(t["raw_news"].union(t["cleaned_articles"]), "text")
    parts = [encoding.restored(x, "row_seq", "text", model).select(F.lit(n).alias("tbl"), "row_seq", "text", "spans", "lost") for n, x in t.items()]
    return parts[0].union(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that recur in at least 4 articles and a tenth of the articles of their outlet."""
    return templates.repeated_lines(table(spark, d, "cleaned_articles"), "row_seq", "article_text", "source_uri")


def p5_templates(spark: SparkSession, d: str) -> DataFrame:
    """The repeated lines of each outlet as templates with slots."""
    return templates.repeated(table(spark, d, "cleaned_articles"), "row_seq", "article_text", "source_uri")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every article without the repeated lines of its outlet."""
    return templates.without_repeated_lines(table(spark, d, "cleaned_articles"), "row_seq", "article_text", "source_uri")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Different spellings of the same outlet."""
    return splits.same_outlet(table(spark, d, "cleaned_articles"), "source_uri")


def p7_split(spark: SparkSession, d: str) -> DataFrame:
    """A split for every article; no outlet is in two of them."""
    return splits.split(table(spark, d, "cleaned_articles"), "row_seq", "source_uri", SHARES)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The proportions reached."""
    return splits.proportions(p7_split(spark, d), SHARES)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and test items that share at least 12 consecutive words."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text").select("doc_id", "item_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The same with the extent of what leaked."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the spans it shares with test items."""
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the sources reach."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents at the hardest reading level."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).where("level = 5").select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """How demanding the texts of each source and language are; the language is the main one of the text, else the labelled one."""
    t, model, channel = _languages(spark, d)
    scored = reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"), keep=["source", "lang", "text"])
    rows = scored.select(F.struct("source", language.code("lang").alias("label"), "difficulty", "level").alias("k"), "text")
    x = language.infer(rows, "k", "text", model, channel).select("k.*", F.coalesce(F.get("languages", F.lit(0))["lang"], "k.label").alias("language"))
    return reading.profile(x, ["source", "language"])


_REGISTERED = (
    p1_found, p1_report, p2_found, p2_languages, p3_found, p3_groups, p4_found, p4_restored, p5_found, p5_templates, p5_clean,
    p7_found, p7_split, p7_report, p8_found, p8_spans, p8_clean, p9_mix, p9_shares, p10_found, p10_levels, p10_profile,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _REGISTERED}
