"""Problem 1: how characteristic a keyword is of its record, by log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.plans.checkpoints import cut
from strataloom.plans.skew import HOT_ROWS, count_join

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))) + " "


def keyword_form(word: Column) -> Column:
    """Lower case, full-width characters as plain ones, no invisible characters, single spaces, trimmed."""
    plain = F.lower(F.translate(word, _WIDE, _PLAIN))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{Cf}", ""), r"(?U)[\s\p{Z}]+", " "))


def llr(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood ratio (G squared) of the table ((a, b), (c, d)); 0 where a margin is 0."""

    def h(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))

    n = a + b + c + d
    return F.greatest(F.lit(0.0), 2 * (h(a) + h(b) + h(c) + h(d) + h(n) - h(a + b) - h(c + d) - h(a + c) - h(b + d)))


def keyword_scores(records: DataFrame, ids: tuple[str, ...] = ("doc_id", "topic_ix"), words: str = "keywords", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(ids, keyword, tf, n_records, score, over): each keyword of each record against all other records.

    The table compares the keyword's count in the record (tf) with its count in the rest of the collection,
    against all other keywords there. ``n_records`` is the number of records that carry it; ``over`` tells
    whether the record uses it more than the rest does.

    Null, blank and empty keywords, null arrays and records without keywords give no rows. A row delivered twice
    counts once; rows of one record with different keyword lists add up. Every keyword keeps its score, ties too.

    Counts per keyword are combined before they are shuffled. They return to the records in a join that keeps
    keywords with ``hot_rows`` or more records in place.
    """
    rows = records.select(*ids, words).where(F.col(words).isNotNull()).distinct()
    terms = rows.select(*ids, F.explode(words).alias("_w")).select(*ids, keyword_form(F.col("_w")).alias("keyword")).where("keyword <> ''")
    tf = cut(terms.groupBy(*ids, "keyword").agg(F.count("*").alias("tf")))  # read four times below
    stats = tf.groupBy("keyword").agg(F.count("*").alias("n_records"), F.sum("tf").alias("cf"))
    total = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"))
    size = tf.groupBy(*ids).agg(F.sum("tf").alias("size"))
    scored = count_join(tf, stats, "keyword", "n_records", F.struct(*ids), hot_rows).join(size, list(ids)).crossJoin(F.broadcast(total))  # one row
    a, b = F.col("tf"), F.col("cf") - F.col("tf")
    c, d = F.col("size") - F.col("tf"), F.col("n") - F.col("size") - F.col("cf") + F.col("tf")
    over = a * (b + d) > b * (a + c)
    return scored.select(*ids, "keyword", "tf", "n_records", llr(*(x.cast("double") for x in (a, b, c, d))).alias("score"), over.alias("over"))


def distinctive_keywords(topic: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    """Scored keywords that at least ``low`` and at most ``high`` topics carry; the bounds are counts, the score ranks what is within them."""
    return keyword_scores(topic).where(F.col("n_records").between(low, high))
