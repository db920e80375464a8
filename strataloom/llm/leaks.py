"""Problem 8: passages of held-out test items inside the corpus, found by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.npwords import chunks, hashed_words, mix
from strataloom.plans.checkpoints import cut
from strataloom.plans.filters import bit_filter, passes

#: Characters of test items that one broadcast index may hold; fingerprints of larger test sets are joined by a shuffle.
BLOCK_CHARS = 8_000_000
#: Bits of the filter through which fingerprints of the corpus go before that shuffle (32 MB).
SIEVE_BITS = 28
#: Bits of the filter that rejects most fingerprints before the search.
FILTER_BITS = 22
#: Elements compared at once.
STEP = 1_000_000

SCHEMA = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint"


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions too near the end are left out)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
        return mix(g)


def winnow(g: np.ndarray, row: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of the rightmost minimum of every ``window`` successive k-grams, k-grams across rows left out.

    Any run of window + k - 1 equal words in two texts has at least one position selected in both.
    """
    inside = row[: len(g)] == row[k - 1 :]
    g = np.where(inside, g, np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(g) < window or window == 1:
        return np.flatnonzero(inside)
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    at = np.arange(len(views)) + (window - 1 - np.argmin(views[:, ::-1], axis=1))
    picked = np.zeros(len(g), bool)
    picked[at] = True
    return np.flatnonzero(picked & inside)


class Index:
    """Fingerprints of a block of test items with the places where they stand."""

    def __init__(self, ids: list[int], texts: list[str], k: int, window: int):
        self.ids = np.array(ids, np.int64)
        self.row, self.words = hashed_words(pa.array(texts, pa.string()))
        self.starts = np.searchsorted(self.row, np.arange(len(ids) + 1))
        grams = kgrams(self.words, k)
        at = winnow(grams, self.row, k, window) if len(grams) else np.empty(0, np.int64)
        order = np.argsort(grams[at], kind="stable")
        self.place = at[order]
        self.prints, self.first, self.count = np.unique(grams[at][order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.prints >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True


def leaks(index: Index, row: np.ndarray, words: np.ndarray, k: int, window: int, span: int, replaced: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, item number, first word in the text, first word in the item, words) of each leaked stretch."""
    grams = kgrams(words, k)
    if not len(grams) or not len(index.prints):
        return
    at = winnow(grams, row, k, window)
    at = at[index.filter[(grams[at] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
    found = np.searchsorted(index.prints, grams[at])
    hit = found < len(index.prints)
    hit[hit] = index.prints[found[hit]] == grams[at[hit]]
    at, found = at[hit], found[hit]
    starts = np.searchsorted(row, np.arange(int(row[-1]) + 2)) if len(row) else np.zeros(1, np.int64)
    # every hit with every place of its fingerprint, in steps; then one line up for each (row, item, shift)
    ends = np.cumsum(index.count[found])
    lined: list[np.ndarray] = []
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP)))
        n = index.count[found[a:b]]
        p = np.repeat(at[a:b], n)
        q = index.place[np.repeat(index.first[found[a:b]], n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)]
        lined.append(np.unique(np.stack([row[p].astype(np.int64), index.row[q].astype(np.int64), p - q]), axis=1))
        a = b
    if not lined:
        return
    doc, item, shift = np.unique(np.concatenate(lined, axis=1), axis=1)
    low = np.maximum(index.starts[item], starts[doc] - shift)
    high = np.minimum(index.starts[item + 1], starts[doc + 1] - shift)
    keep = high - low >= span
    doc, item, shift, low, high = doc[keep], item[keep], shift[keep], low[keep], high[keep]
    ends = np.cumsum(high - low)
    a = 0
    while a < len(doc):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP)))
        n = high[a:b] - low[a:b]
        line = np.repeat(np.arange(b - a), n)
        q = np.repeat(low[a:b], n) + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        same = index.words[q] == words[q + np.repeat(shift[a:b], n)]
        sums = np.concatenate([[0], np.cumsum(same)])
        # a window of ``span`` words on one line, its first and last word equal, at most ``replaced`` others not
        good = same[: len(same) - span + 1] & same[span - 1 :] & (line[: len(line) - span + 1] == line[span - 1 :])
        good &= sums[span:] - sums[:-span] >= span - replaced
        where = np.flatnonzero(good)
        if len(where):
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(where) > 1) | (line[where[1:]] != line[where[:-1]])]))
            first, last = where[cut], where[np.append(cut[1:], len(where)) - 1]
            one = line[first] + a
            yield doc[one], item[one], q[first] + shift[one] - starts[doc[one]], q[first] - index.starts[item[one]], last - first + span
        a = b


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               span: int = 20, replaced: int = 2, k: int = 5, window: int = 2) -> DataFrame:
    """Stretches of test items in a corpus: (doc_id, item_id, doc_word, item_word, n_words).

    A stretch is ``span`` or more successive words of the item's text in the document, with at most
    ``replaced`` of any ``span`` words replaced; letter case, punctuation and line ends do not count.
    Both sides are winnowed: any ``window`` + ``k`` - 1 equal words share a fingerprint, and a span with its
    replacements always holds such a run: (span - replaced) / (replaced + 1) rounded up must be that long.
    Shared fingerprints are joined, lined up, and each line-up is compared word by word, which is exact.

    The corpus is read once and its texts are never shuffled. Test items of up to ``BLOCK_CHARS`` characters are one broadcast
    index, which the corpus is searched with in place. Of larger ones, the fingerprints become a filter of fixed
    size, and those fingerprints of the corpus that pass it are joined with them, each with the words around it, which is all
    that the comparison needs (``joined_leaks``). Both ways give the same rows.

    Null or empty texts, items shorter than ``span`` words and an empty table give no rows. Rows delivered
    twice give the same stretch once. Extra columns are ignored.
    """
    run = -(-(span - replaced) // (replaced + 1))
    if window + k - 1 > run:
        raise ValueError(f"window + k - 1 must be at most {run} to find every span")
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null and text <> ''")
    tests = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = tests.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if total > BLOCK_CHARS:
        return joined_leaks(corpus, tests, span, replaced, k, window)
    chosen = tests.collect() if total else []
    index = spark.sparkContext.broadcast(Index([r["item_id"] for r in chosen], [r["text"] for r in chosen], k, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, words = hashed_words(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                for doc, item, p, q, n in leaks(index.value, row, words, k, window, span, replaced):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array(index.value.ids[item], pa.int64()), *(pa.array(x, pa.int64()) for x in (p, q, n))], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return corpus.mapInArrow(search, SCHEMA).distinct()


def fingerprints(texts: DataFrame, key: str, blank: int, span: int, k: int, window: int, sieve: np.ndarray | None = None) -> DataFrame:
    """(print, key, at, around): the winnowed fingerprints of each text, or those that pass ``sieve``.

    ``around`` are the hashes of the words that a span with the fingerprint can reach, ``blank`` beyond the ends of the text.
    """
    packed = None if sieve is None else texts.sparkSession.sparkContext.broadcast(sieve)
    names = ["print", key, "at", "around"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, words = hashed_words(part.column("text"))
                grams = kgrams(words, k)
                if not len(grams):
                    continue
                at = winnow(grams, row, k, window)
                if packed is not None:
                    at = at[passes(packed.value, grams[at].view(np.int64), SIEVE_BITS)]
                ids = part.column(key).to_numpy(zero_copy_only=False)
                starts = np.searchsorted(row, np.arange(part.num_rows + 1))
                for i in range(0, len(at), STEP // 16):
                    some = at[i : i + STEP // 16]
                    where = some[:, None] + np.arange(k - span, span)
                    inside = (where >= starts[row[some]][:, None]) & (where < starts[row[some] + 1][:, None])
                    around = np.where(inside, words[np.clip(where, 0, len(words) - 1)], np.uint64(blank))
                    yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(ids[row[some]], pa.int64()), pa.array(some - starts[row[some]], pa.int64()), pa.array([x.tobytes() for x in around], pa.binary())], names=names)

    return texts.select(key, "text").mapInArrow(read, f"print bigint, {key} bigint, at bigint, around binary")


def joined_leaks(corpus: DataFrame, tests: DataFrame, span: int, replaced: int, k: int, window: int) -> DataFrame:
    """The stretches of ``find_leaks``, by a join of fingerprints.

    A span with its replacements holds a fingerprint of both texts, so every one is seen in the words around some
    pair of equal fingerprints; successive spans on one line then make up a stretch. Fingerprints that very many places share are
    split by the adaptive skew join.
    """
    mine = cut(fingerprints(tests, "item_id", 1, span, k, window))
    sieve = bit_filter(mine, "print", SIEVE_BITS)
    theirs = fingerprints(corpus, "doc_id", 2, span, k, window, sieve)
    both = theirs.join(mine.select("print", "item_id", F.col("at").alias("item_at"), F.col("around").alias("item_around")), "print")
    width = 2 * span - k

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, width) for i in (2, 5))
            same = a == b
            sums = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            good = same[:, : width - span + 1] & same[:, span - 1 :] & (sums[:, span:] - sums[:, :-span] >= span - replaced)
            row, j = np.nonzero(good)
            doc, p, item, q = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            first = q[row] + k - span + j
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[row], item[row], (p - q)[row], first)], names=["doc_id", "item_id", "shift", "first"])

    spans = both.select("doc_id", "at", "around", "item_id", "item_at", "item_around").mapInArrow(compare, "doc_id bigint, item_id bigint, shift bigint, first bigint").distinct()
    line = Window.partitionBy("doc_id", "item_id", "shift").orderBy("first")  # at most the words of one item
    runs_of = spans.withColumn("run", F.col("first") - F.row_number().over(line)).groupBy("doc_id", "item_id", "shift", "run").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    return runs_of.select("doc_id", "item_id", (F.col("first") + F.col("shift")).alias("doc_word"), F.col("first").alias("item_word"), (F.col("n") + span - 1).alias("n_words"))


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item leaked into it."""
    return find_leaks(docs, items).select("doc_id", "item_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item: documents that hold it, and the longest stretch found; items without a leak have 0."""
    found = find_leaks(docs, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
    every = items.select("item_id", "suite").distinct()
    return every.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"), F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest"))
