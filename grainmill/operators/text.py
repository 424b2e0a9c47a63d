"""Tokens, n-grams, counts and weights of terms, long tables throughout (document, term, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"([A-Za-z]{2,}[0-9]?)"
TERM = r"(\w\w+)"


def tokens(text: Column, pattern: str = TOKEN, stop_words: Sequence[str] = (), lower: bool = True) -> Column:
    """An array of tokens by a Java pattern with one group, without stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)
    found = F.transform(found, F.lower) if lower else found
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~F.lower(t).isin([w.lower() for w in stop_words]))


def white_space(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_and_punctuation(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\w+|[^\w\s]+)"), 1)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\s*\n\s*\n\s*"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Cut after . ! or ? and white space."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda t: t != "")


def exploded(df: DataFrame, keys: Sequence[str], array: Column, name: str = "token") -> DataFrame:
    """One row a token, with its place from 0."""
    return df.select(*keys, F.posexplode(array).alias("pos", name))


def grams(array: Column, n: int) -> Column:
    """The n-grams of a token array, joined by spaces."""
    if n == 1:
        return array
    starts = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(array, i, n), " "))


def term_counts(df: DataFrame, keys: Sequence[str], text: str, n: Sequence[int] = (1,), pattern: str = TOKEN, stop_words: Sequence[str] = ()) -> DataFrame:
    """(keys, term, n): how often each n-gram is in each document; the counts combine before the shuffle."""
    base = df.select(*keys, tokens(F.col(text), pattern, stop_words).alias("_t"))
    terms = F.explode(F.concat(*(grams(F.col("_t"), k) for k in n))).alias("term")
    return base.select(*keys, terms).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, key: str, min_df: float = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, total) within document-frequency bounds (whole: rows, float: share); ties by term."""
    v = counts.groupBy("term").agg(F.count_distinct(key).alias("df"), F.sum("n").alias("total"))
    if isinstance(min_df, float) or isinstance(max_df, float):
        v = v.crossJoin(F.broadcast(counts.agg(F.count_distinct(key).alias("_n"))))
        bound = lambda x: F.col("_n") * x if isinstance(x, float) else F.lit(x)
        v = v.where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df))).drop("_n")
    else:
        v = v.where((F.col("df") >= min_df) & (F.col("df") <= max_df))
    return v.orderBy(F.col("total").desc(), "term").limit(max_features) if max_features else v


def tfidf(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, tfidf): n (ln((1 + docs) / (1 + df)) + 1), each document's row of length 1."""
    docs = F.broadcast(counts.agg(F.count_distinct(key).alias("_d")))
    df_ = counts.groupBy("term").agg(F.count("*").alias("_f"))
    w = counts.join(df_, "term").crossJoin(docs).withColumn("_w", F.col("n") * (F.log((1 + F.col("_d")) / (1 + F.col("_f"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("_w") / norm).alias("tfidf"))


def row_frequency(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def top_terms(counts: DataFrame, by: Sequence[str], k: int, value: str = "n") -> DataFrame:
    """The k largest terms of each group; ties by term."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), "term"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def group_terms(counts: DataFrame, by: Sequence[str], k: int, title: bool = True) -> DataFrame:
    """Each group's k largest terms with their share of what is kept; Title Case if asked."""
    total = counts.groupBy(*by, "term").agg(F.sum("n").alias("n"))
    out = top_terms(total, by, k).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return out.withColumn("term", F.initcap("term")) if title else out


def transitions(tops: DataFrame, period: str, last: int) -> DataFrame:
    """(period, term_from, term_to): terms of consecutive periods; '' marks one that ends or begins."""
    a = tops.where(F.col(period) < last).select(F.col(period).alias("p"), F.col("term").alias("term_from"))
    b = tops.where(F.col(period) > 0).select((F.col(period) - 1).alias("q"), F.col("term").alias("term_to"))
    both = a.join(b, (F.col("p") == F.col("q")) & (F.col("term_from") == F.col("term_to")), "full")
    return both.select(F.coalesce("p", "q").alias(period), F.coalesce("term_from", F.lit("")).alias("term_from"), F.coalesce("term_to", F.lit("")).alias("term_to"))


def new_terms(tops: DataFrame, period: str) -> DataFrame:
    """Terms of a period that the one before lacks."""
    before = tops.select((F.col(period) + 1).alias(period), "term")
    return tops.where(F.col(period) > 0).select(period, "term").join(before, [period, "term"], "left_anti")


def positions(tops: DataFrame, by: Sequence[str]) -> DataFrame:
    """Places scaled by the last one and held within [.001, .999]."""
    scaled = F.col("place") / F.max("place").over(Window.partitionBy(*by))
    return tops.withColumn("y", F.least(F.lit(0.999), F.greatest(F.lit(0.001), scaled)))


def mentions(df: DataFrame, keys: Sequence[str], text: str, pattern: str) -> DataFrame:
    """(keys, pos, match) for every match of a pattern with one group."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("pos", "match"))
