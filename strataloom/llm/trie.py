"""Known words near an unknown one: Levenshtein automata walked along vocabulary tries that are spread over partitions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words of one trie, and unknown words walked along it by one task; parts with more are divided.
TRIE_WORDS, ASKED_WORDS = 50_000, 100_000
#: Character confusions a word may have.
CONFUSED = 3
#: Letters from which a word may also have one plain edit, and length of its skeleton from which two.
ONE_EDIT, TWO_EDITS = 5, 13

# What a reader prints for a character, and the character (l for i only among capitals).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("c", "e"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("d", "cl"), ("m", "rn"), ("2", "z"),
)

_TOKEN = re.compile(r"[^\W_]+")
_ONE = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "6": "b", "8": "b", "9": "g", "e": "c", "2": "z"})


def morph(letters: str) -> str:
    """Lower-case letters with all that readers confuse made equal, character by character."""
    for a, b in (("u", "ii"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("w", "vv")):
        letters = letters.replace(a, b)
    return letters.translate(_ONE)


def skeleton(text: str) -> str:
    """Letters and digits of ``text`` with all that readers confuse made equal: confusions and capitals (of ß too) do not change it."""
    return morph("".join(_TOKEN.findall(text.casefold())))


def fold_case(word: str) -> str:
    """Lower case, but an l next to a capital becomes the marker I: among capitals it is often a misread I."""
    low = word.lower()
    if "l" not in word or len(low) != len(word) or not any(c.isupper() for c in word):
        return low
    return "".join("I" if c == "l" and ((i and word[i - 1].isupper()) or (i + 1 < len(word) and word[i + 1].isupper())) else low[i] for i, c in enumerate(word))


def plain_edits(key: str) -> int:
    """Plain Levenshtein edits allowed for a word: none for short ones and those with digits, two for long ones."""
    if len(key) < ONE_EDIT or not key.isalpha():
        return 0
    return 2 if len(skeleton(key)) >= TWO_EDITS else 1


class Vocabulary:
    """Known words as a sorted list, which serves as a trie: a node is the range of words with one prefix."""

    def __init__(self, words):
        self.words = sorted(words)

    def continues(self, prefix: str) -> bool:
        """Does a longer known word begin with ``prefix``?"""
        i = bisect_left(self.words, prefix)
        i += i < len(self.words) and self.words[i] == prefix
        return i < len(self.words) and self.words[i].startswith(prefix)

    def child(self, prefix: str, low: int, high: int) -> tuple[int, int]:
        low = bisect_left(self.words, prefix, low, high)
        return low, bisect_left(self.words, prefix[:-1] + chr(ord(prefix[-1]) + 1), low, high)

    def children(self, prefix: str, low: int, high: int) -> Iterator[tuple[str, int, int]]:
        n = len(prefix)
        if low < high and len(self.words[low]) == n:
            low += 1
        while low < high:
            step = prefix + self.words[low][n]
            end = self.child(step, low, high)[1]
            yield step, low, end
            low = end

    def candidates(self, word: str, confused: int = CONFUSED, edits: int = 0) -> list[tuple[str, int, int]]:
        """All (known word, confusions, edits) that the automaton of ``word`` accepts.

        The automaton allows up to ``confused`` character confusions and up to ``edits`` of the usual Levenshtein
        edits; it walks the trie along with the word, so every known word within reach is found. ``word`` is in
        lower case, with capital-context l written as the capital I marker (see ``fold_case``).
        """
        best: dict[str, tuple[int, int]] = {}
        seen: dict[tuple[int, str], set[tuple[int, int]]] = {}
        stack = [(0, "", 0, len(self.words), 0, 0)]
        n = len(word)
        while stack:
            i, prefix, low, high, c, e = stack.pop()
            if low >= high:
                continue
            states = seen.setdefault((i, prefix), set())
            if any(a <= c and b <= e for a, b in states):
                continue
            states.add((c, e))
            if i == n and len(self.words[low]) == len(prefix):
                old = best.get(prefix)
                if old is None or (e, c) < (old[1], old[0]):
                    best[prefix] = (c, e)
            if i < n:
                ch = "l" if word[i] == "I" else word[i]
                p = prefix + ch
                stack.append((i + 1, p, *self.child(p, low, high), c, e))
                if c < confused:
                    for a, b in CONFUSIONS:
                        if word.startswith(a, i):
                            p, lo, hi = prefix, low, high
                            for x in b:
                                p += x
                                lo, hi = self.child(p, lo, hi)
                            stack.append((i + len(a), p, lo, hi, c + 1, e))
                    if word[i] == "I":
                        p = prefix + "i"
                        stack.append((i + 1, p, *self.child(p, low, high), c + 1, e))
            if e < edits:
                if i < n:
                    stack.append((i + 1, prefix, low, high, c, e + 1))
                for p, lo, hi in self.children(prefix, low, high):
                    stack.append((i, p, lo, hi, c, e + 1))
                    if i < n:
                        stack.append((i + 1, p, lo, hi, c, e + 1))
        return [(w, c, e) for w, (c, e) in best.items() if c or e]


def homes(word: str) -> list[str]:
    """The parts of the vocabulary that hold a known word: by the beginning, the end and the middle of its skeleton."""
    s = skeleton(word)
    return [f"<{s[:2]}", f">{s[-2:]}", *([f"={s[5:8]}"] if len(s) > 7 else [])]


def routes(key: str) -> list[str]:
    """The parts to be walked for an unknown word, so that no known word in reach is missed.

    Confusions leave the skeleton alone. A plain edit replaces at most two characters of it by at most two: one edit
    cannot touch both the first two and the last two of five or more; of thirteen or more, two edits that touch both
    leave the characters from the third to the fourth from the end alone, moved by at most two places.
    """
    s, n = skeleton(key), plain_edits(key)
    return [f"<{s[:2]}", *([f">{s[-2:]}"] if n else []), *([f"={s[5 - d : 8 - d]}" for d in range(-2, 3)] if n > 1 else [])]


@F.pandas_udf(ArrayType(StringType()))
def _homes(word: pd.Series) -> pd.Series:
    return word.map(homes)


@F.pandas_udf(ArrayType(StringType()))
def _routes(key: pd.Series) -> pd.Series:
    return key.map(lambda k: list(dict.fromkeys(routes(k))))


FOUND = "key string, word string, n bigint, confused int, edits int, continues boolean"


def near_words(unknown: DataFrame, known: DataFrame, trie_words: int = TRIE_WORDS, asked_words: int = ASKED_WORDS) -> DataFrame:
    """(key, word, n, confused, edits, continues): all known words in reach of each unknown one.

    ``unknown`` is (key), distinct; ``known`` is (word, n), words distinct. Rows without a word tell of a key that a longer known
    word begins with it. A word found along several routes comes out several times.

    Known words are kept in parts by two characters of their skeleton (see ``homes``), and each unknown word visits the
    few parts that can hold a word in reach. Parts with more than ``trie_words`` words become several tries, and parts asked
    for more than ``asked_words`` words are walked by several tasks, so no task depends on the size of a part.
    """
    k = known.select(F.explode(_homes("word")).alias("part"), "word", "n")
    u = unknown.select(F.explode(_routes("key")).alias("part"), "key")
    size = k.groupBy("part").agg(F.count("*").alias("n")).join(u.groupBy("part").agg(F.count("*").alias("m")), "part")
    size = size.select("part", F.ceil(F.col("n") / trie_words).cast("int").alias("tries"), F.ceil(F.col("m") / asked_words).cast("int").alias("tasks"))
    a = k.join(size, "part").select("part", F.pmod(F.hash("word"), "tries").alias("trie"), F.explode(F.sequence(F.lit(1), "tasks")).alias("task"), F.lit(0).alias("tag"), "word", "n")
    b = u.join(size, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("trie"), (F.pmod(F.hash("key"), "tasks") + 1).alias("task"), F.lit(1).alias("tag"), F.col("key").alias("word"), F.lit(0).cast("bigint").alias("n"))
    parts = max(1, int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = a.unionAll(b).repartition(parts, "part", "trie", "task").sortWithinPartitions("part", "trie", "task", "tag", "word")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, words, trie = None, {}, None
        for batch in batches:
            out: list[tuple] = []
            cols = (batch.column(i).to_pylist() for i in range(6))
            for part, number, task, tag, word, n in zip(*cols, strict=True):
                if (part, number, task) != here:
                    here, words, trie = (part, number, task), {}, None
                if tag == 0:
                    words[word] = n
                    continue
                if trie is None:
                    trie = Vocabulary(words)
                out += [(word, w, words[w], c, e, False) for w, c, e in trie.candidates(word, CONFUSED, plain_edits(word))]
                if part[0] == "<" and trie.continues(word.lower().replace("I", "l")):
                    out.append((word, None, None, None, None, True))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return rows.select("part", "trie", "task", "tag", "word", "n").mapInArrow(walk, FOUND)
