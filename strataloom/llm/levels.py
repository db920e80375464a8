"""Problem 9: reading level by smoothed unigram models, one per level, over words and sentence shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.npwords import category_table, chunks, codepoints, lower_table, mix, runs, space_table, span_hashes

#: At most this many labelled documents train the models (those with the lowest hash of their id).
TRAIN_DOCS = 20_000
#: Added to every count.
SMOOTHING = 0.5
#: Times a sentence's shape counts against one word.
SHAPE_WEIGHT = 2
#: Documents with fewer words (separated by white space) get no level.
MIN_WORDS = 40
LEVELS = 4


def _shape(kind: int, value: np.ndarray) -> np.ndarray:
    """Token hashes of sentence shapes, apart from those of words."""
    return mix(np.uint64(0xA5A5_0000_0000_0000) + np.uint64(kind << 32) + value.astype(np.uint64))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, weight) of every token, and the white-space words of each row.

    Prose is a paragraph line with at least 4 words that ends like a sentence; its words in lower case are
    tokens, and so are the length and the commas of each of its sentences. A text with no such line counts all
    its words instead, so that lists and headings alone also get a level.
    """
    cp, offsets = codepoints(col)
    rows = len(offsets) - 1
    space = space_table()[cp]
    wrow, _, _ = runs(~space, offsets)
    n_words = np.bincount(wrow, minlength=rows)
    row, start, end = runs(category_table("L M")[cp], offsets)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), n_words
    # paragraphs: lines, or several lines of which all but the last do not end a sentence (hard-wrapped text)
    at_row = np.zeros(len(cp) + 1, bool)
    at_row[offsets] = True
    stop = np.isin(cp, np.array([ord(c) for c in ".!?…"], np.uint32))
    closing = np.isin(cp, np.array([ord(c) for c in "\"'”’»)]"], np.uint32))
    line_row, line_start, line_end = runs(~((cp == 10) | (cp == 13)), offsets)
    solid = np.flatnonzero(~space & ~closing)
    # the last character of a line that is neither blank nor closing
    k = np.searchsorted(solid, line_end) - 1
    last = np.where((k >= 0) & (solid[np.maximum(k, 0)] >= line_start), solid[np.maximum(k, 0)], -1)
    ended = (last >= 0) & stop[np.maximum(last, 0)]
    line = np.searchsorted(line_start, start, side="right") - 1
    per_line = np.bincount(line, minlength=len(line_start))
    prose = ended & (per_line >= 4)
    # an unended line of 4 or more words directly before a prose line is its first part
    if len(line_start):
        gap = line_start[1:] - line_end[:-1]
        one_end = (gap <= 1) | ((gap == 2) & (cp[line_end[:-1]] == 13) & (cp[line_start[1:] - 1] == 10))
        joined = np.append(one_end & (line_row[:-1] == line_row[1:]) & ~ended[:-1] & (per_line[:-1] >= 6), False)
        last_of = np.flatnonzero(~joined)  # the last line of each run of joined ones
        prose = prose[last_of[np.searchsorted(last_of, np.arange(len(joined)))]]
    keep = prose[line]
    has = np.bincount(row, weights=keep, minlength=rows) > 0
    keep |= ~has[row]
    row, start, end, line = row[keep], start[keep], end[keep], line[keep]
    words = span_hashes(lower_table()[cp], start, end)
    # sentences: a stop followed by white space or the line's end, not between lines joined above
    follow = np.concatenate([space[1:], [True]]) | at_row[1:]
    after = np.concatenate([closing[1:], [False]])
    breaks = stop & (follow | after)
    number = np.cumsum(breaks)
    hard = np.cumsum(np.concatenate([[0], ended & prose | ~prose]))[line]  # lines that end what they hold
    sid = np.stack([row, hard, number[start]])
    new = np.flatnonzero(np.concatenate([[True], (np.diff(sid, axis=1) != 0).any(axis=0)]))
    size = np.diff(np.append(new, len(row)))
    commas = np.concatenate([[0], np.cumsum((cp == ord(",")) | (cp == ord(";")))])
    final = np.append(new[1:], len(row)) - 1
    n_commas = commas[end[final]] - commas[start[new]]
    sent = size >= 2
    srow = row[new][sent]
    length = _shape(1, np.minimum(14, (2 * np.log2(np.maximum(size[sent], 1))).astype(np.int64)))
    nested = _shape(2, np.minimum(6, n_commas[sent]))
    weight = np.concatenate([np.ones(len(words), np.int64), np.full(2 * len(srow), SHAPE_WEIGHT, np.int64)])
    return np.concatenate([row, srow, srow]), np.concatenate([words, length, nested]), weight, n_words


def _counts(docs: DataFrame) -> DataFrame:
    """(level, token, n) of documents (level, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, token, weight, _ = tokens(part.column("text"))
                level = part.column("level").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                order = np.lexsort((token, level))
                level, token, weight = level[order], token[order], weight[order]
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), (np.diff(token) != 0) | (np.diff(level) != 0)]))
                n = np.add.reduceat(weight, first) if len(first) else weight
                yield pa.RecordBatch.from_arrays([pa.array(level[first], pa.int32()), pa.array(token[first].view(np.int64)), pa.array(n, pa.int64())], names=["level", "token", "n"])

    return docs.select("level", "text").mapInArrow(count, "level int, token bigint, n bigint").groupBy("level", "token").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of tokens under each level."""

    def __init__(self, level: np.ndarray, token: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.tokens, place = np.unique(token.view(np.uint64), return_inverse=True)
        counts = np.full((LEVELS, len(self.tokens) + 1), SMOOTHING)
        np.add.at(counts, (level - 1, place), n)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).T
        self.log[-1] = 0  # a token of no training document says nothing
        self.prior = np.log((docs + SMOOTHING) / (docs + SMOOTHING).sum())

    def scores(self, row: np.ndarray, token: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.tokens):
            return np.tile(self.prior, (rows, 1))
        i = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
        i = np.where(self.tokens[i] == token, i, len(self.tokens))
        return np.stack([np.bincount(row, weights=self.log[i, k] * weight, minlength=rows) for k in range(LEVELS)], axis=1) + self.prior


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Models from labelled documents; a document with two labels trains both levels.

    Labels outside 1 to 4, labels of unknown documents and repeated labels are left out.
    """
    good = labels.where(F.col("level").between(1, LEVELS) & F.col("doc_id").isNotNull()).select("doc_id", "level").distinct()
    chosen = good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    good = good.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most train_docs rows
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(good), "doc_id")  # at most 4 x train_docs rows
    got = _counts(texts).toPandas()
    n_docs = {r["level"]: r["n"] for r in good.groupBy("level").agg(F.count("*").alias("n")).collect()}
    return Model(got["level"].to_numpy(np.int64), got["token"].to_numpy(np.int64), got["n"].to_numpy(float), np.array([n_docs.get(k + 1, 0) for k in range(LEVELS)], float))


def reading_levels(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, level, confidence, n_words): the level of highest posterior likelihood of each document.

    Unigram models per level are trained on the labelled documents (at most ``train_docs`` of them) over the
    words of all languages together with sentence shapes, which all languages share. All documents of at least
    ``min_words`` words are then scored in one pass without a shuffle. ``confidence`` is the posterior.

    Null, empty and short texts have no row. Without any label every document gets the prior's first level.
    Rows delivered twice come out once. Extra columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, token, weight, n = tokens(part.column("text"))
                s = model.value.scores(row, token, weight, part.num_rows)
                s = np.exp(s - s.max(axis=1, keepdims=True))
                best = s.argmax(axis=1)
                keep = n >= min_words
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array((best + 1)[keep], pa.int32()), pa.array((s.max(axis=1) / s.sum(axis=1))[keep]), pa.array(n[keep], pa.int64())], names=["doc_id", "level", "confidence", "n_words"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null and text <> ''")
    return texts.mapInArrow(score, "doc_id bigint, level int, confidence double, n_words bigint").dropDuplicates(["doc_id"])


def level_profile(levels: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents and words of each level by source."""
    meta = docs.select("doc_id", "source").dropDuplicates(["doc_id"])
    return levels.join(meta, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))
