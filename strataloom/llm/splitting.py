"""Problem 5: oversized texts cut at natural boundaries, by lexical cohesion."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.plans.filters import distinct_in_place

#: Sentences on either side of a gap whose words are compared.
SIDE = 3
#: A cut keeps at least this share of the limit, where a boundary allows.
LEAST = 0.5

PIECES = "doc_id bigint, pos int, type string, piece_ix int, n_pieces int, char_start int, char_end int, overlap int, text string, boundary string"

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?…;。！？][\"'”’»)\]]*\s+|\n\s*")
_ROW = re.compile(r"\],\s*|\n")
_LINE = re.compile(r"\n")
_BLANK = re.compile(r"\s+")


def boundaries(text: str, kind: str) -> list[int]:
    """Positions after which a natural unit starts: lines of code, rows of tables, sentences elsewhere."""
    pattern = _LINE if kind == "code" else _ROW if kind == "table" else _SENTENCE
    return [m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)]


def depths(text: str, cuts: list[int], side: int = SIDE) -> list[float]:
    """Depth of the similarity valley at each cut: how far the word overlap of both sides falls below the peaks around."""
    edges = [0, *cuts, len(text)]
    bags = [Counter(w.lower() for w in _WORD.findall(text[a:b])) for a, b in zip(edges, edges[1:])]
    likeness = []
    left, right = Counter(), Counter()
    for b in bags[1 : 1 + side]:
        right.update(b)
    for i in range(len(cuts)):
        left.update(bags[i])
        if i >= side:
            left.subtract(bags[i - side])
        if i:
            right.subtract(bags[i])
            if i + side < len(bags):
                right.update(bags[i + side])
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(n * large[w] for w, n in small.items() if n)
        norm = (sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5
        likeness.append(dot / norm if norm else 0.0)
        if i % 64 == 63:  # drop words counted down to nothing
            left, right = +left, +right
    # climb to the peak on each side in one sweep each
    n = len(likeness)
    lpeak, rpeak = likeness[:], likeness[:]
    for i in range(1, n):
        lpeak[i] = lpeak[i - 1] if likeness[i - 1] >= likeness[i] else likeness[i]
    for i in range(n - 2, -1, -1):
        rpeak[i] = rpeak[i + 1] if likeness[i + 1] >= likeness[i] else likeness[i]
    return [lp + rp - 2 * s for lp, rp, s in zip(lpeak, rpeak, likeness)]


def split_text(text: str, kind: str, size: int, overlap: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, boundary at the end) of the pieces; each starts ``overlap`` characters before the last one's end.

    Within each size window the cut is the natural boundary with the deepest cohesion valley (the later of equal
    ones); without a natural boundary the last white space, else a hard cut that parts no letter from its marks.
    """
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("need size > overlap >= 0 and size >= 1")
    if len(text) <= size:
        return [(0, len(text), "end")]
    cuts = boundaries(text, kind)
    depth = depths(text, cuts)
    out: list[tuple[int, int, str]] = []
    start = 0
    while len(text) - start > size:
        top = start + size
        low = start + max(overlap + 1, int(size * LEAST))
        a, b = bisect_left(cuts, low), bisect_right(cuts, top)
        if a == b:  # none in the upper part of the window: any that moves forward
            a = bisect_left(cuts, start + overlap + 1)
        if a < b:
            best = max(range(a, b), key=lambda i: (depth[i], i))
            end, why = cuts[best], "valley"
        else:
            blank = next((m for m in range(top, start + overlap + 1, -1) if text[m - 1].isspace()), None)
            end, why = (blank, "blank") if blank else (top, "hard")
            while why == "hard" and end > start + overlap + 1 and unicodedata.combining(text[end]):
                end -= 1
        out.append((start, end, why))
        start = end - overlap
    out.append((start, len(text), "end"))
    return out


def split_oversized(block: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the blocks whose text exceeds the limit of their type, as stored, in code points.

    ``limits`` is the table size_limit; its rows for blocks are reduced to one per type (the smallest), so the
    broadcast has one row per block type. Blocks within their limit, of types without one, and null texts have no
    rows here. Every piece has at most max_size characters, and two successive pieces share exactly ``overlap``
    characters, so the first piece and the others without their overlap make the text again.

    Rows delivered twice are cut once. Only oversized texts reach Python, and only they are shuffled.
    """
    caps = limits.where("applies_to = 'block' and type is not null and max_size > 0").groupBy("type").agg(F.min(F.struct("max_size", F.coalesce("overlap", F.lit(0)).alias("overlap"))).alias("m")).select(F.col("type").alias("_type"), "m.*")
    over = block.select("doc_id", "pos", "type", "text").join(F.broadcast(caps), F.col("type") == F.col("_type")).where(F.length("text") > F.col("max_size")).select("doc_id", "pos", "type", "text", "max_size", F.least("overlap", F.col("max_size") - 1).alias("overlap"))
    over = over.dropDuplicates(["doc_id", "pos", "type", "text"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                got = split_text(r.text, r.type, int(r.max_size), int(r.overlap))
                rows += [(r.doc_id, r.pos, r.type, i, len(got), a, b, int(r.overlap) if i else 0, r.text[a:b], why) for i, (a, b, why) in enumerate(got)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return over.mapInPandas(cut, PIECES)


def oversized_blocks(block: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, pos) of the blocks that had to be cut."""
    return split_oversized(block, limits).where("n_pieces > 1").select("doc_id", "pos").distinct()


def all_pieces(block: DataFrame, limits: DataFrame) -> DataFrame:
    """Every block with a text, oversized ones as their pieces: (doc_id, pos, piece_ix, n_pieces, text).

    Rows delivered twice come out once; only those and oversized texts are shuffled.
    """
    cut = split_oversized(block, limits).select("doc_id", "pos", "piece_ix", "n_pieces", "text")
    caps = limits.where("applies_to = 'block' and type is not null and max_size > 0").groupBy(F.col("type").alias("_type")).agg(F.min("max_size").alias("max_size"))
    whole = block.where("text is not null").select("doc_id", "pos", "type", "text").join(F.broadcast(caps), F.col("type") == F.col("_type"), "left").where("max_size is null or length(text) <= max_size")
    whole = distinct_in_place(whole.select("doc_id", "pos", "text")).select("doc_id", "pos", F.lit(0).alias("piece_ix"), F.lit(1).alias("n_pieces"), "text")
    return whole.unionAll(cut.distinct())
