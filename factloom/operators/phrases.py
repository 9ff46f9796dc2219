"""Phrases of a vocabulary in normalised texts, token by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Tokens of a text that one row carries.
CHUNK = 64


def find_phrases(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text_norm", phrase: str = "phrase") -> DataFrame:
    """key, phrase, start, end (characters from 0) of every occurrence; overlapping ones too. Tokens are what single spaces part.

    A text is cut in chunks of CHUNK tokens, each with its place in the text and as many tokens more as the longest phrase has. Each token of a chunk is joined with the
    phrases that begin with it, and only then the rest is compared. So rows are of bounded size, and the work grows with the text, not with its square.
    """
    vocabulary = phrases.select(F.col(phrase).alias("phrase")).where("phrase <> ''").distinct()
    vocabulary = vocabulary.withColumn("factloom_own", F.split("phrase", " ")).withColumn("factloom_n", F.size("factloom_own")).withColumn("factloom_token", F.col("factloom_own")[0])
    longest = vocabulary.agg(F.max("factloom_n")).first()[0] or 1
    tokens = texts.select(key, F.split(text, " ").alias("t"))
    starts = F.sequence(F.lit(0), F.size("t") - 1, F.lit(CHUNK))
    chunks = tokens.select(key, F.transform(starts, lambda i: F.struct(F.slice("t", i + 1, CHUNK + longest - 1).alias("tokens"), F.length(F.array_join(F.slice("t", i + 1, F.lit(CHUNK)), " ")).alias("n"))).alias("c"))
    # where each chunk begins: the lengths of those before it and a space after each
    based = chunks.select(key, F.posexplode(F.transform("c", lambda x, i: F.struct(x["tokens"].alias("tokens"), F.aggregate(F.slice("c", F.lit(1), i), F.lit(0), lambda total, y: total + y["n"] + 1).alias("base")))).alias("k", "x"))
    each = based.select(key, "x.base", "x.tokens", F.posexplode(F.slice("x.tokens", 1, CHUNK)).alias("j", "factloom_token"))
    hits = each.join(vocabulary, "factloom_token").where(F.slice("tokens", F.col("j") + 1, F.col("factloom_n")) == F.col("factloom_own"))
    start = F.col("base") + F.when(F.col("j") > 0, F.length(F.array_join(F.slice("tokens", F.lit(1), F.col("j")), " ")) + 1).otherwise(0)
    return hits.select(key, "phrase", start.cast("int").alias("start"), (start + F.length("phrase")).cast("int").alias("end"))


def longest_spans(spans: DataFrame, key: str) -> DataFrame:
    """The spans that no other span of the same text contains; overlapping ones both stay."""
    every = spans.groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("factloom_all"))
    wider = F.exists("factloom_all", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")) & (s["end"] - s["start"] > F.col("end") - F.col("start")))
    return spans.join(every, key).where(~wider).select(*spans.columns)


def best_span(start: Column, end: Column) -> Column:
    """Ordering key for max_by: the longest, of these the first."""
    return F.struct((end - start), -start)


def best_phrase(spans: DataFrame, key: str) -> DataFrame:
    return spans.groupBy(key).agg(F.max_by("phrase", best_span(F.col("start"), F.col("end"))).alias("phrase"))


def bounded_substrings(texts: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str = "phrase") -> DataFrame:
    """key, phrase for phrases that stand in the text between characters that are no letters or digits; punctuation counts as written.

    Phrases with a letter or digit meet the texts that have their first word; the others, which have none to meet by, are few and are looked for in every text.
    """
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("phrase"), F.lit(r"\E(?![\p{L}\p{N}])"))
    vocabulary = phrases.select(F.col(phrase).alias("phrase")).where("phrase <> ''").distinct()
    vocabulary = vocabulary.withColumn("factloom_word", F.regexp_extract("phrase", r"[\p{L}\p{N}]+", 0))
    # the empty word stands for phrases without any
    words = texts.select(key, F.col(text).alias("factloom_text"), F.explode(F.array_distinct(F.concat(F.split(text, r"[^\p{L}\p{N}]+"), F.array(F.lit(""))))).alias("factloom_word"))
    return words.join(vocabulary, "factloom_word").where(F.regexp_like("factloom_text", quoted)).select(key, "phrase").distinct()
