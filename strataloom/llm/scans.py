"""Problem 3: text of scanned pages repaired: divided words, misread characters, page furniture."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from strataloom.llm.canonical import canonical
from strataloom.llm.npwords import category_table, chunks, codepoints, lower_table, mix, runs, span_hashes
from strataloom.llm.trie import fold_case, morph, near_words, skeleton
from strataloom.plans.checkpoints import cut
from strataloom.plans.filters import bit_filter, passes
from strataloom.plans.running import next_value, running_total
from strataloom.plans.skew import HOT_ROWS, count_join, fits

#: Words in at least this many clean documents, or blocks of clean documents, are known.
MIN_TEXTS = 3
#: The most frequent known words are broadcast, so that only rarer words are looked up in the vocabulary by a join.
COMMON_WORDS = 30_000
#: Scanned documents whose ids and titles may be broadcast; more are joined by hash, large documents in place.
MAX_BROADCAST = 1_000_000
#: Positions of a document within which the next block is found by one window.
STRETCH = 2_000
#: Bits of the filter that tells which pairs of neighbouring words are of interest.
PAIR_BITS = 24
TYPES = ("paragraph", "list_item", "note")
KINDS = ("split_word", "misread", "running_head", "page_number")

_TOKEN = re.compile(r"[^\W_]+")
_SOFT = "­¬"
_HYPHENS = "-‐‑" + _SOFT
_SPLIT = re.compile(rf"([^\W\d_]+)([{_HYPHENS}])([^\S\n]*\n\s*|[^\S\n]+)([^\W_]+)")
_END = re.compile(rf"([^\W\d_]+)([{_HYPHENS}])\s*$")
_START = re.compile(r"\s*([^\W_]+)")
_TAIL = re.compile(r"\s*\S+")
_NUMBER = r"(?:[-–—]\s*\d{1,5}\s*[-–—]|\[\s*\d{1,5}\s*\]|(?:pp?\.|page|pag\.|pág\.|página|seite|s\.)\s*\d{1,5}(?:\s*(?:/|of|de|von|sur)\s*\d{1,5})?|\d{1,5}\s*/\s*\d{1,5}|\d{1,5})"
_PAGE = re.compile(rf"{_NUMBER}$", re.I)
_BEFORE = re.compile(rf"({_NUMBER})\s+(?=\S)", re.I)
_AFTER = re.compile(rf"(?<=\S)\s+({_NUMBER})$", re.I)
_NUMBER_END = re.compile(rf"(?:^|\s)({_NUMBER})\s+$", re.I)
_NUMBER_START = re.compile(rf"\s+({_NUMBER})(?=\s|$)", re.I)


def like(word: str, model: str) -> str:
    """``word`` in the capitals of ``model``."""
    if sum(c.isupper() for c in model) > 1 or (len(model) == 1 and model.isupper()):
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() or (model[:1].isdigit() and word[:1] != word[:1].lower()) else word


def latin(word: str) -> bool:
    return any(c.isalpha() for c in word) and all(ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 for c in word)


def askable(word: str) -> bool:
    """Can the word be one of the vocabulary, or misread from one?"""
    return len(word) > 1 and not word.isdigit() and latin(word)


class Heads:
    """The running titles of a document."""

    def __init__(self, titles: list[str]):
        self.skeletons = {skeleton(t) for t in titles if t} - {""}
        self.longest = max(map(len, self.skeletons), default=0)
        said = [t.strip() for t in titles if t and t.strip()]
        self.titles = sorted({x.lower() for t in said for x in (t, t.upper())}, key=lambda t: (-len(t), t))

    def __contains__(self, line: str) -> bool:
        letters = "".join(_TOKEN.findall(line.casefold()))
        return 0 < len(letters) <= self.longest and morph(letters) in self.skeletons  # a skeleton is never shorter than its letters


@lru_cache(maxsize=256)
def heads_of(title: str | None, head: str | None) -> Heads:
    return Heads([title, head])


def furniture(text: str, heads: Heads) -> tuple[str, set[str], list[str]]:
    """The text without the lines of page furniture, the kinds found, and what was removed."""
    kinds: set[str] = set()
    lines = text.split("\n")
    what: list[str] = []
    for line in lines:
        s = line.strip()
        kind = ""
        if s:
            if s in heads:
                kind = "h"
            elif _PAGE.match(s):
                kind = "d" if s.isdigit() else "p"
            else:
                for m in (_BEFORE.match(s), _AFTER.search(s)):
                    if m:
                        rest = s[m.end() :] if m.start() == 0 else s[: m.start()]
                        if rest in heads:
                            kind = "hp"
                            break
        what.append(kind)
    filled = [i for i, line in enumerate(lines) if line.strip()]
    for k, i in enumerate(filled):
        if what[i] == "d":  # bare digits: a whole block, a line between others, or next to a running head
            beside = [what[filled[j]] for j in (k - 1, k + 1) if 0 <= j < len(filled)]
            if not (len(filled) == 1 or 0 < k < len(filled) - 1 or any("h" in b for b in beside)):
                what[i] = ""
    for w in what:
        if "h" in w:
            kinds.add("running_head")
        if "p" in w or "d" in w:
            kinds.add("page_number")
    removed = [line for line, w in zip(lines, what, strict=True) if w]
    return "\n".join(line for line, w in zip(lines, what, strict=True) if not w), kinds, removed


def inline(text: str, heads: Heads) -> tuple[str, set[str]]:
    """Without furniture inside a line: a page number beside the running title where line ends became blanks.

    A title in capitals is one too if the text around is not; but short ones may be plain words, so they need the number.
    """
    kinds: set[str] = set()
    for t in heads.titles:
        at = text.lower().find(t)
        while at >= 0 and len(text) >= len(t) + 12 and len(text.lower()) == len(text):
            end = at + len(t)
            whole = not (text[at - 1 : at].isalnum() or text[end : end + 1].isalnum())
            before = _NUMBER_END.search(text[:at]) if whole else None
            after = _NUMBER_START.match(text, end) if whole else None
            shout = whole and len(t) >= 8 and text[at:end].isupper() and not text.isupper()
            if not (before or shout or (after and text[at - 1 : at] in ("", " "))):
                at = text.lower().find(t, end)
                continue
            a = before.start(1) if before else at
            b = after.end(1) if after and not before else end
            kinds.add("running_head")
            if before or after:
                kinds.add("page_number")
            text = text[:a] + text[b:].lstrip()
            at = text.lower().find(t, a)
    return text, kinds


def questions(text: str, gone: str, common: frozenset[str]) -> list[tuple[str, str | None, str | None]]:
    """(key, left, right) of the words of a block that are not common ones, and of what divided words may be.

    ``left`` and ``right`` are the neighbouring words in lower case.
    """
    asks: dict[tuple, None] = {}

    def ask(word: str, left: str | None = None, right: str | None = None) -> None:
        if askable(word) and word.lower() not in common:
            asks[fold_case(word), left, right] = None

    words = _TOKEN.findall(text)
    for i, w in enumerate(words):
        ask(w, words[i - 1].lower() if i else None, words[i + 1].lower() if i + 1 < len(words) else None)
    for m in _SPLIT.finditer(text):
        for w in (m[1] + m[4], m[1], m[4]):
            ask(w)
    for w in _TOKEN.findall(gone):
        ask(w)
    return list(asks)


class Answers:
    """What the vocabulary says of the words of one block: common ones, and those that were asked for."""

    def __init__(self, common: frozenset[str], asked: dict[str, tuple[bool, str | None, bool]]):
        self.common, self.asked = common, asked

    def known(self, word: str) -> bool:
        return word.lower() in self.common or self.asked.get(fold_case(word), (False,))[0]

    def fix(self, word: str) -> str | None:
        """The known word that an unknown one was most likely printed for."""
        return None if self.known(word) else self.asked.get(fold_case(word), (False, None))[1]

    def continues(self, word: str) -> bool:
        return self.asked.get(fold_case(word), (False, None, False))[2]

    def runs_on(self, end: str, mark: str, start: str) -> bool:
        """Are the last word of a block and the first of the next one the halves of a word?"""
        if not (start.islower() or end.isupper()):
            return False
        return self.known(end + start) or self.fix(end + start) is not None or (mark in _SOFT and not self.known(start))

    def divided(self, a: str, mark: str, b: str) -> str | None:
        """The whole word if ``a`` and ``b`` are halves of one that ``mark`` divides, else None."""
        whole = a + b
        if self.known(whole) or mark in _SOFT or self.fix(whole):
            return whole
        if b[0].isdigit() or b[0].isupper() != (a.isupper() and len(a) > 1):
            return None
        return None if all(self.known(x) or self.fix(x) is not None for x in (a, b)) else whole


def reflow(text: str) -> str:
    return re.sub(r"\s*\n\s*", " ", text).strip()


def repair(text: str, gone: str, answers: Answers, after: list[tuple[str, str]], before: list[tuple[str, str, str | None]]) -> tuple[set[str], str | None]:
    """The kinds of faults that ``answers`` show in a block without furniture, and its text without them.

    ``after`` are the blocks that its last word may run into, by their first word and all that is printed together with it;
    ``before`` those whose last word may run into this one: that word, the mark that divides it, and the first word of the
    block to be tried before this one. The tail of a word that runs into a later block moves to the block
    with its first half; None stands for a text of which nothing is left.
    """
    kinds: set[str] = set()
    if any(answers.fix(w) for w in _TOKEN.findall(gone)):
        kinds.add("misread")
    start = _START.match(text)
    if start and any(answers.runs_on(end, mark, start[1]) and not (other and answers.runs_on(end, mark, other)) for end, mark, other in before):
        text = text[_TAIL.match(text).end() :].lstrip()
        if not text:
            return kinds, None
    end = _END.search(text)

    def join(m: re.Match) -> str:
        whole = answers.divided(m[1], m[2], m[4])
        if whole is None:
            return m[1] + m[2] + ("" if m[2] == "-" and "\n" in m[3] else m[3]) + m[4]
        kinds.add("split_word")
        return whole

    text = _SPLIT.sub(join, text)
    if end:
        tail = next((t for first, t in after if first and answers.runs_on(end[1], end[2], first)), None)
        if tail is not None:
            text = text[: _END.search(text).end(1)] + tail
        if tail is not None or not answers.known(end[1]):
            kinds.add("split_word")

    def mend(m: re.Match) -> str:
        fixed = answers.fix(m[0]) if askable(m[0]) else None
        if not fixed or (answers.continues(m[0]) and not _TOKEN.search(m.string, m.end())):
            return m[0]  # the last word of a block may be cut off: then it is the beginning of a known one
        kinds.add("misread")
        return like(fixed, m[0])

    return kinds, reflow(_TOKEN.sub(mend, text))


def word_texts(docs: DataFrame) -> DataFrame:
    """(word, n): in how many texts each word of two or more letters occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                cp, offsets = codepoints(part.column("text"))
                low = lower_table()[cp]
                row, start, end = runs(category_table("L M")[cp], offsets)
                keep = end - start > 1
                row, start, end = row[keep], start[keep], end[keep]
                h = span_hashes(low, start, end)
                order = np.lexsort((row, h))
                h, row, start, end = h[order], row[order], start[order], end[order]
                new = np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])
                doc = new | np.concatenate([np.ones(min(1, len(h)), bool), row[1:] != row[:-1]])
                first = np.flatnonzero(new)
                n = np.add.reduceat(doc.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
                text = low.astype("<u4").tobytes().decode("utf-32-le", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([text[a:b] for a, b in zip(start[first], end[first], strict=True)], pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def known_words(texts: tuple[DataFrame, ...]) -> DataFrame:
    """(word, n): words in at least MIN_TEXTS texts of one of the kinds given, with the greatest number of texts of a kind."""
    parts = [word_texts(t).where(F.col("n") >= MIN_TEXTS) for t in texts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("word").agg(F.max("n").alias("n"))


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of neighbouring words."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def pair_counts(texts: tuple[DataFrame, ...], wanted: DataFrame) -> DataFrame:
    """(pair, n): how often the wanted pairs of neighbouring words (hashes, column ``pair``) stand in the texts.

    A filter of fixed size drops nearly all other pairs where they are read.
    """
    wanted = wanted.select("pair").distinct()
    spark = wanted.sparkSession
    sieve = spark.sparkContext.broadcast(bit_filter(wanted, "pair", PAIR_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                cp, offsets = codepoints(part.column("text"))
                row, start, end = runs(category_table("L M")[cp], offsets)
                h = span_hashes(lower_table()[cp], start, end)
                pair = _pairs(h[:-1], h[1:])[row[:-1] == row[1:]].view(np.int64)
                got, n = np.unique(pair[passes(sieve.value, pair, PAIR_BITS)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(n.astype(np.int64))], names=["pair", "n"])

    every = texts[0].select("text")
    for t in texts[1:]:
        every = every.unionAll(t.select("text"))
    counted = every.where("text is not null").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.join(wanted, "pair", "left_semi")


def _hashes(words: pd.Series) -> np.ndarray:
    cp, offsets = codepoints(pa.array(words, pa.string()))
    return span_hashes(lower_table()[cp], offsets[:-1], offsets[1:])


@F.pandas_udf(LongType())
def _pair(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(_pairs(_hashes(left), _hashes(right)).view(np.int64))


@F.pandas_udf(StringType())
def _key(word: pd.Series) -> pd.Series:
    return word.map(lambda w: fold_case(w) if askable(w) else None, na_action="ignore")


READ = "doc_id bigint, pos int, type string, page int, kinds array<string>, text string, gone string, open boolean, plain boolean, pure boolean, asks array<struct<key: string, left: string, right: string>>, end string, mark string, start string, tail string"


def read_blocks(rows: DataFrame, common: frozenset[str]) -> DataFrame:
    """Blocks (doc_id, pos, type, text, page, title, head), sorted by place and text, each once, without page furniture.

    ``open`` blocks hold something that takes the vocabulary or the blocks around them to decide; ``plain`` ones are of TYPES and have text left;
    ``asks`` are their questions; ``end`` and ``start`` their divided last and their first word.
    """
    spark = rows.sparkSession
    frequent = spark.sparkContext.broadcast(common)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "pos", "type", "page", "kinds", "text", "gone", "open", "plain", "pure", "asks", "end", "mark", "start", "tail"]
        ask = pa.struct([("key", pa.string()), ("left", pa.string()), ("right", pa.string())])
        kinds_of = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(ask), *[pa.string()] * 4]
        last = None
        for batch in batches:
            out = []
            forms = canonical(batch.column("text"))[0].to_pylist()
            cols = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, 6))
            for form, doc, pos, kind, text, page, title, head in zip(forms, *cols, strict=True):
                if (doc, pos) == last:
                    continue
                last = (doc, pos)
                if kind not in TYPES or text is None:
                    out.append((doc, pos, kind, page, [], text, "", False, False, False, [], None, None, None, None))
                    continue
                heads = heads_of(title, head)
                left, kinds, removed = furniture(form, heads)
                if "\n" not in form and not kinds:
                    left, kinds = inline(form, heads)
                gone = "\n".join(removed)
                pure = bool(kinds) and not left.strip()
                asks = questions("" if pure else left, gone, frequent.value)
                end = None if pure else _END.search(left)
                start = None if pure else _START.match(left)
                unsure = bool(asks or end or (not pure and _SPLIT.search(left)))
                out.append((
                    doc, pos, kind, page, sorted(kinds), None if pure else left if unsure else reflow(left), gone if asks else "", unsure, not pure, pure,
                    [dict(zip(("key", "left", "right"), a, strict=True)) for a in asks],
                    end and end[1], end and end[2], start and start[1], start and _TAIL.match(left)[0].strip(),
                ))
            cols_out = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_out, kinds_of, strict=True)], names=names)

    return rows.select("doc_id", "pos", "type", "text", "page", "title", "head").mapInArrow(read, READ)


def block_borders(read: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, pos, end, mark, near, far): blocks that end with a divided word, and the blocks that it may run into.

    ``near`` is the next block with text; ``far`` the first one behind the next page furniture or page end, where a block that is
    not divided stands between (a note at the foot of the page). Both are (pos, start, tail).
    """
    seen = running_total(read.select("doc_id", "pos", "page", "plain", "end", "mark", "start", "tail", "pure"), "doc_id", "pos", F.col("pure").cast("int"), "furniture", stretch)
    here = F.struct(F.coalesce("page", F.lit(-1)).alias("page"), "furniture")
    x = seen.where("plain").select("doc_id", "pos", "end", "mark", here.alias("part"), F.struct("pos", "start", "tail").alias("me"))
    x = next_value(x, "doc_id", "pos", F.struct("me", "part"), "n", stretch)
    turn = F.when(F.col("n").isNotNull() & (F.col("n.part") != F.col("part")), F.struct(F.col("n.me").alias("me"), F.col("end").isNull().alias("free")))
    x = next_value(x, "doc_id", "pos", turn, "t", stretch).where("end is not null and n is not null")
    return x.select("doc_id", "pos", "end", "mark", F.col("n.me").alias("near"), F.when(F.col("t.free"), F.col("t.me")).alias("far"))


def look_up(asks: DataFrame, known: DataFrame, texts: tuple[DataFrame, ...], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, pos, key, known, fix, continues) of the asked words that the vocabulary says anything about.

    Unknown words meet the known ones in reach (``near_words``); of those with fewest plain edits and then fewest confusions,
    the one stands for it that its neighbours in the block have beside them most often in the clean texts, then the
    more frequent one, then the first in spelling. Plain edits count only where the neighbours speak for them, and not for the
    beginning of a longer known word, which may have been cut off.
    """
    keys = cut(asks.groupBy("key").agg(F.count("*").alias("n_asks")))
    here = keys.withColumn("word", F.translate("key", "I", "l")).join(known.select("word", F.lit(True).alias("known")), "word", "left")
    unknown = here.where("known is null").select("key")
    found = near_words(unknown, known)
    named = found.where("word is not null").select("key", F.struct("edits", "confused", F.col("word").alias("w"), "n").alias("c"))
    told = named.unionByName(found.where("continues").select("key"), allowMissingColumns=True)
    told = told.groupBy("key").agg(F.collect_set("c").alias("c"), F.max(F.col("c").isNull()).alias("continues"))  # words in reach of one word
    least = F.array_min("c")
    told = told.withColumn("c", F.filter("c", lambda c: (c["edits"] == least["edits"]) & (c["confused"] == least["confused"])))
    answers = here.join(told, "key", "left").where("known or c is not null")
    answers = cut(answers.select("key", "n_asks", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("c", F.array()).alias("c"), F.coalesce("continues", F.lit(False)).alias("continues")))
    got = count_join(asks, answers, "key", "n_asks", F.struct("doc_id", "pos"), hot_rows)
    sure = (F.size("c") == 0) | ((F.size("c") == 1) & (F.element_at("c", 1)["edits"] == 0))
    plain = got.where(sure).select("doc_id", "pos", "key", "known", F.when(F.size("c") == 1, F.element_at("c", 1)["w"]).alias("fix"), "continues").distinct()
    rows = got.where(~sure).select("doc_id", "pos", "key", "continues", "left", "right", F.explode("c").alias("c"))
    sides = F.array(F.when(F.col("left").isNotNull(), F.struct(F.col("left").alias("a"), F.col("c.w").alias("b"))), F.when(F.col("right").isNotNull(), F.struct(F.col("c.w").alias("a"), F.col("right").alias("b"))))
    rows = rows.select("doc_id", "pos", "key", "continues", "c", F.explode_outer(F.array_compact(sides)).alias("s"))
    rows = cut(rows.select("doc_id", "pos", "key", "continues", "c", _pair(F.coalesce("s.a", F.lit("")), F.coalesce("s.b", F.lit(""))).alias("pair"), F.col("s").isNotNull().alias("placed")))
    near = pair_counts(texts, rows.where("placed").drop("placed"))
    wanted = rows.where("placed").drop("placed").groupBy("pair").agg(F.count("*").alias("rows")).join(near, "pair")
    support = count_join(rows.where("placed").drop("placed"), wanted, "pair", "rows", F.struct("doc_id", "pos"), hot_rows)
    support = rows.select("doc_id", "pos", "key", "continues", "c", F.lit(0).cast("bigint").alias("n")).unionByName(support.select("doc_id", "pos", "key", "continues", "c", "n"))
    each = support.groupBy("doc_id", "pos", "key", "continues", "c").agg(F.sum("n").alias("near")).where("c.edits = 0 or (near > 0 and not continues)")
    best = each.groupBy("doc_id", "pos", "key", "continues").agg(F.min(F.struct((-F.col("near")).alias("a"), (-F.col("c.n")).alias("b"), F.col("c.w").alias("w"))).alias("m"))
    return plain.unionByName(best.select("doc_id", "pos", "key", F.lit(False).alias("known"), F.col("m.w").alias("fix"), "continues"))


OUT = "doc_id bigint, pos int, type string, page int, kinds array<string>, text string"


def decide(blocks: DataFrame, common: frozenset[str]) -> DataFrame:
    """Open blocks with the answers to their questions, repaired."""
    frequent = blocks.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                answers = Answers(frequent.value, {a["key"]: (a["known"], a["fix"], a["continues"]) for a in r["answers"] or []})
                after = [(x["start"], x["tail"]) for x in r["after"] or [] if x]
                before = [(x["end"], x["mark"], x["other"]) for x in r["before"] or []]
                kinds, text = repair(r["text"] or "", r["gone"], answers, after, before)
                out.append((r["doc_id"], r["pos"], r["type"], r["page"], sorted(kinds | set(r["kinds"])), None if r["text"] is None else text))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds_of = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_of, strict=True)], names=["doc_id", "pos", "type", "page", "kinds", "text"])

    return blocks.mapInArrow(work, OUT)


def repaired_scans(block: DataFrame, docs: DataFrame, scan_kind: str = "pdf_scan", common_words: int = COMMON_WORDS, max_broadcast: int = MAX_BROADCAST, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, pos, type, page, kinds, text) of every block of the scanned documents.

    ``kinds`` tells what was wrong (see ``KINDS``); ``text`` is the repaired text: page furniture removed, divided
    words joined (the tail of a word that runs into a later block moves to its first half), misread words
    corrected, line ends turned into blanks. It is null for a block that held furniture only, or the tail of a word.
    Blocks of other types than paragraph, list item and note come out as they are, without kinds.

    Known words are those in MIN_TEXTS clean documents or blocks; they stay a distributed table. Blocks are read once; the words in
    them that are not among the ``common_words`` most frequent ones (the only words that are broadcast) are looked up by joins, each
    distinct one once (``look_up``), and the answers return to their blocks. No step needs a document at once, so one of any
    length spreads over tasks; whether a word runs on into a later block is decided from the same facts on both sides.

    Null texts stay null; rows delivered twice (same position) count once, the first in text order; a document's first heading
    counts as a title too; documents without a row in ``docs`` are no scans; empty tables give no rows.
    """
    kinds = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_kind") == scan_kind, F.lit(False))).alias("scan"), F.min(F.when(F.col("doc_kind") == scan_kind, F.col("title"))).alias("title"))
    scans = kinds.where("scan").select("doc_id", "title")
    slim = block.select("doc_id", "pos", "type", "text", "page")
    small = fits(scans, max_broadcast)
    clean = docs.where(F.col("doc_kind").isNull() | (F.col("doc_kind") != scan_kind)).select("text")
    if small:
        mine = slim.join(F.broadcast(scans.select("doc_id")), "doc_id", "left_semi")
        others = slim.join(F.broadcast(scans.select("doc_id")), "doc_id", "left_anti")
    else:
        sizes = block.groupBy("doc_id").agg(F.count("*").alias("n_rows")).join(kinds.select("doc_id", "scan"), "doc_id", "left")
        placed = count_join(slim, sizes, "doc_id", "n_rows", F.col("pos"), hot_rows)
        mine, others = placed.where("scan").select(slim.columns), placed.where("scan is null or not scan").select(slim.columns)
    texts = (clean, others.where(F.col("type").isin(*TYPES)).select("text"))
    known = cut(known_words(texts))
    common = frozenset(r["word"] for r in known.orderBy(F.desc("n"), "word").limit(common_words).collect())
    heads = mine.groupBy("doc_id").agg(F.min_by("text", F.when(F.expr("type = 'heading' and text is not null"), F.col("pos"))).alias("head"), F.count("*").alias("n_rows"))
    meta = scans.join(heads, "doc_id")
    rows = mine.join(F.broadcast(meta.drop("n_rows")), "doc_id") if small else count_join(mine, meta, "doc_id", "n_rows", F.col("pos"), hot_rows)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = cut(read_blocks(rows.repartition(parts, "doc_id", "pos").sortWithinPartitions("doc_id", "pos", "text"), common))
    borders = cut(block_borders(read))
    own = read.where("size(asks) > 0").select("doc_id", "pos", F.inline("asks"))
    # both sides of a border get the same facts
    pairs = borders.select("doc_id", "pos", "end", "mark", F.explode(F.array(F.struct("near", F.lit(None).cast("string").alias("other")), F.struct(F.col("far").alias("near"), F.col("near.start").alias("other")))).alias("x"))
    pairs = pairs.where("x.near is not null").select("doc_id", "pos", "end", "mark", F.col("x.near").alias("next"), "x.other")
    halves = F.array("end", *(F.concat("end", c) for c in ("next.start", "other")), "next.start", "other")
    ends = pairs.select("doc_id", F.explode(F.array("pos", "next.pos")).alias("pos"), halves.alias("w")).select("doc_id", "pos", F.explode("w").alias("w"))
    rare = ends.select("doc_id", "pos", _key("w").alias("key")).where("key is not null")
    asks = own.unionByName(rare.select("doc_id", "pos", "key", F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right")))
    told = look_up(asks, known, texts, hot_rows).groupBy("doc_id", "pos").agg(F.collect_list(F.struct("key", "known", "fix", "continues")).alias("answers"))  # words of one block
    after = borders.select("doc_id", "pos", F.array("near", "far").alias("after"))
    before = pairs.select("doc_id", F.col("next.pos").alias("pos"), F.struct("end", "mark", "other").alias("b")).groupBy("doc_id", "pos").agg(F.collect_list("b").alias("before"))  # two at most
    told = told.unionByName(after, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)
    told = told.groupBy("doc_id", "pos").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("answers", "after", "before")))
    joined = read.where("plain or open").join(told, ["doc_id", "pos"], "left").where("open or size(before) > 0")
    todo = joined.select("doc_id", "pos", "type", "page", "kinds", "text", "gone", "answers", "after", "before")
    done = read.where("not open").join(before.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti").select("doc_id", "pos", "type", "page", "kinds", "text")
    return done.unionByName(decide(todo, common))


def scan_faults(block: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pos, kind), one row per fault kind of a block."""
    return repaired_scans(block, docs).select("doc_id", "pos", F.explode("kinds").alias("kind")).distinct()
