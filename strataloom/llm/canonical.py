"""Problem 6: one consistent form of texts that look alike, on code-point arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.npwords import TOP, category_table, chunks, codepoints, runs

FULL_WIDTH, LIGATURE, MARK, ZERO_WIDTH, SPACE, MIXED = 1, 2, 4, 8, 16, 32
FLAGS = {"full_width": FULL_WIDTH, "ligature": LIGATURE, "combining": MARK, "zero_width": ZERO_WIDTH, "space": SPACE, "mixed_script": MIXED}

ZERO_WIDTHS = (0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
# Letters of other scripts and the Latin letters they look like, in the same order.
LOOK_ALIKES = (
    ("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһԍ", "ABESIJKMHOPCTYXaesijopcyxdqwhg"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυγ", "ABEZHIKMNOPTYXaivopuy"),  # Greek
    ("кмтвнгп", "kmtbhrn"),  # Cyrillic small letters alike in some typefaces
    ("ԼՍՏՕգզհյոռսցօ", "LUSOqqhjnnugo"),  # Armenian
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),  # Coptic
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHGhZbRWSVSLCPKdGB"),  # Cherokee
    ("ყჿ", "yo"),  # Georgian
)
#: Scripts whose letters are mistaken for Latin ones; letters of scripts that are written without blanks (Han, Thai) may
#: well stand beside Latin words.
ALPHABETS = ("GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE", "GEORGIAN")
#: Ranges of forms that stand for one plain character and are folded, though they are no fault: half-width letters, mathematical ones.
PLAIN_FORMS = ((0xFF61, 0xFFDC), (0x1D400, 0x1D7FF))
_LATIN, _OTHER = 1, 2


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over code points, made by rule from the character database."""
    n = 0x110000
    fold = np.arange(n, dtype=np.uint32)
    length = np.ones(n, np.int8)
    flag = np.zeros(n, np.uint8)
    script = np.zeros(n, np.uint8)
    ccc = np.zeros(n, np.uint8)
    pairs: dict[tuple[int, int], int] = {}
    count = np.ones(n, np.int8)
    for c in range(TOP):
        ch = chr(c)
        if 0xFF01 <= c <= 0xFF5E or 0xFFE0 <= c <= 0xFFE6:
            fold[c] = ord(unicodedata.normalize("NFKC", ch)[0])
            flag[c] |= FULL_WIDTH
        kind = unicodedata.category(ch)
        if kind == "Zs" and c != 0x20:
            fold[c], flag[c] = 0x20, flag[c] | SPACE
        ccc[c] = unicodedata.combining(ch)
        if kind[0] in "LM":
            name = unicodedata.name(ch, "")
            if kind[0] == "L":
                script[c] = _LATIN if "LATIN" in name else _OTHER if name.startswith(ALPHABETS) else 0
        parts = unicodedata.decomposition(ch).split()
        if parts and not parts[0].startswith("<"):
            count[c] = len(unicodedata.normalize("NFD", ch))
            composed = unicodedata.normalize("NFC", ch)
            if len(parts) == 2 and composed == ch:
                pairs[int(parts[0], 16), int(parts[1], 16)] = c
            elif len(composed) == 1 and composed != ch and flag[c] == 0:
                fold[c] = ord(composed)
    for first, last in PLAIN_FORMS:
        for c in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1:
                fold[c] = ord(plain)
    for c in ZERO_WIDTHS:
        length[c], flag[c] = 0, ZERO_WIDTH
    for c, text in LIGATURES.items():
        length[c], flag[c] = len(text), LIGATURE
    alike = np.zeros(n, np.uint32)
    for a, b in LOOK_ALIKES:
        alike[[ord(x) for x in a]] = [ord(x) for x in b]
    keys = sorted(pairs)
    return {
        "fold": fold, "length": length, "flag": flag, "script": script, "ccc": ccc, "alike": alike,
        "letter": category_table("L M"), "mark": ccc > 0, "parts": count,
        "pair": np.array([(a << 21) | b for a, b in keys], np.int64), "composed": np.array([pairs[k] for k in keys], np.uint32),
        # what needs a closer look: anything that is folded, flagged, a mark, or a letter of another script
        "odd": (fold != np.arange(n)) | (flag > 0) | (ccc > 0) | (script == _OTHER),
    }


def decompose_bases(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composed letters that marks follow, taken apart, so that all marks can be put in order.

    Returns code points, offsets, and which code points stood in the text as they are.
    """
    t = tables()
    _, start, _ = runs(t["mark"][cp], offsets)
    base = start[start > 0] - 1
    base = base[t["parts"][cp[base]] > 1]
    if not len(base):
        return cp, offsets, np.ones(len(cp), bool)
    length = np.ones(len(cp), np.int64)
    length[base] = t["parts"][cp[base]]
    ends = np.concatenate([[0], np.cumsum(length)])
    src = np.repeat(np.arange(len(cp)), length)
    out, own = cp[src], np.ones(len(src), bool)
    for c in np.unique(cp[base]):
        where = base[cp[base] == c]
        for k, ch in enumerate(unicodedata.normalize("NFD", chr(c))):
            out[ends[where] + k] = ord(ch)
            own[ends[where] + k] = k == 0
    return out, ends[offsets], own


def compose(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical composition of letters and marks: code points, offsets, and the rows in which a mark was composed.

    Marks are put in canonical order, then the first, second, ... marks of all runs are composed at once.
    """
    t = tables()
    cp, offsets, own = decompose_bases(cp, offsets)
    cp = cp.copy()
    keep = np.ones(len(cp), bool)
    row, start, end = runs(t["mark"][cp], offsets)
    done = np.zeros(len(offsets) - 1, bool)
    if not len(start):
        return cp, offsets, done
    long = end - start > 1
    if long.any():
        n = (end - start)[long]
        at = np.repeat(start[long], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((t["ccc"][cp[at]], np.repeat(np.arange(len(n)), n)))
        cp[at], own[at] = cp[at][order], own[at][order]
    rowstart = np.zeros(len(cp) + 1, bool)
    rowstart[offsets] = True
    ok = (start > 0) & ~rowstart[start]  # a base before the marks, in the same row
    row, start, end = row[ok], start[ok], end[ok]
    base = start - 1
    last = np.zeros(len(start), np.uint8)
    step = 0
    while len(start):
        at = start + step
        mark = cp[at].astype(np.int64)
        key = (cp[base].astype(np.int64) << 21) | mark
        i = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        free = (last == 0) | (last < t["ccc"][mark])
        hit = (t["pair"][i] == key) & free
        cp[base[hit]] = t["composed"][i[hit]]
        keep[at[hit]] = False
        done[row[hit & own[at]]] = True
        last = np.where(hit, last, t["ccc"][mark])
        step += 1
        more = start + step < end
        row, start, end, base, last = row[more], start[more], end[more], base[more], last[more]
    left = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    return cp[keep], left[offsets], done


def canonical(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The consistent form of each text, and what was found in it (bits of ``FLAGS``). Null stays null."""
    t = tables()
    cp, offsets = codepoints(col)
    n = len(offsets) - 1
    found = np.zeros(n, np.uint8)
    odd = t["odd"][cp]
    sums = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(odd, out=sums[1:])
    rows = np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])
    if not len(rows):
        return col, found
    size = (offsets[1:] - offsets[:-1])[rows]
    at = np.repeat(offsets[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    cp, offsets = cp[at], np.concatenate([[0], np.cumsum(size)])
    bits = np.bitwise_or.reduceat(t["flag"][cp], offsets[:-1])
    # expansions and deletions
    length = t["length"][cp].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(length)])
    src = np.repeat(np.arange(len(cp)), length)
    out = t["fold"][cp][src]
    for c in np.flatnonzero(t["length"] > 1):
        where = np.flatnonzero(cp == c)
        for k, ch in enumerate(LIGATURES[int(c)]):
            out[ends[where] + k] = ord(ch)
    offsets = ends[offsets]
    # letters of another script inside a Latin word
    _, start, end = runs(t["letter"][out], offsets)
    if len(start):
        kind = t["script"][out]
        latin = np.concatenate([[0], np.cumsum(kind == _LATIN)])
        other = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        both = (latin[end] > latin[start]) & (other[end] > other[start])
        start, end = start[both], end[both]
        bits[np.searchsorted(offsets, start, side="right") - 1] |= MIXED
        size = end - start
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        swap = t["alike"][out[at]]
        out[at] = np.where(swap > 0, swap, out[at])
    out, offsets, composed = compose(out, offsets)
    bits[composed] |= MARK
    found[rows] = bits
    # back to Arrow
    raw = out.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = np.ones(len(out), np.int64) + (out > 0x7F) + (out > 0x7FF) + (out > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])[offsets]
    fixed = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
    text = col.cast(pa.large_string())
    mask = np.zeros(n, bool)
    mask[rows] = True
    return pc.replace_with_mask(text, pa.array(mask), fixed), found


SCHEMA = "field string, doc_id bigint, ix int, text string, found int"


def canonical_texts(texts: DataFrame) -> DataFrame:
    """``texts`` (field, doc_id, ix, text) with text in its consistent form and ``found``, the bits of ``FLAGS``.

    Full-width forms and presentation ligatures become plain letters, special spaces the space; zero-width
    characters go; letters of another script inside a Latin word become the Latin letters they look like (those that look like
    none stay); marks are composed with their letters. Half-width and mathematical letters become plain ones, without being a fault. Whole words or symbols of other scripts, hyphens, dashes and quotation
    marks stay. Conjoining Hangul letters stay as they are.

    Null stays null and empty stays empty, both with nothing found. Every row comes out, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                text, found = canonical(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("field"), part.column("doc_id"), part.column("ix"), text.cast(pa.string()), pa.array(found.astype(np.int32))], names=["field", "doc_id", "ix", "text", "found"])

    return texts.select("field", F.col("doc_id").cast("bigint"), F.col("ix").cast("int"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def block_and_title_texts(block: DataFrame, topic: DataFrame) -> DataFrame:
    """The two texts of problem 6 as (field, doc_id, ix, text)."""
    return block.select(F.lit("block_text").alias("field"), "doc_id", F.col("pos").alias("ix"), "text").unionAll(topic.select(F.lit("topic_title").alias("field"), "doc_id", F.col("topic_ix").alias("ix"), F.col("title").alias("text")))
