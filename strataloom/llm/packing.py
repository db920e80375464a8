"""Problem 7: texts into containers of a fixed number of tokens, with certified bounds."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.plans.checkpoints import cut

#: Public byte-level BPE vocabulary used where neither a path nor the setting spark.strataloom.tokenizer is given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces packed together by one task.
GROUP_ITEMS = 50_000
#: Times that groups above their bound exchange pieces and are packed again.
ROUNDS = 2

SIZES = "doc_id bigint, piece_ix int, n_pieces int, n_tokens int, char_start bigint, char_end bigint"
PACKED = "container_id string, doc_id bigint, piece_ix int, n_pieces int, n_tokens int, char_start bigint, char_end bigint, bins int, bound int"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a ``.tiktoken`` rank file."""
    import tiktoken
    from public_tokenizers import PATTERN

    if not os.path.exists(path):
        raise FileNotFoundError(f"no rank file of a public tokenizer at {path}; name one that every executor can read")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, path: str, capacity: int) -> list[tuple[int, int, int]]:
    """(tokens, first character, end) of the pieces of a text; one piece if it fits.

    A text over the capacity is cut at the last token that begins a word, before the capacity is reached;
    where a stretch has no such token (or none at a character's start), at the last token that fits.
    """
    enc = tokenizer(path)
    tokens = enc.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(len(tokens), 0, len(text))]
    parts = [enc.decode_single_token_bytes(t) for t in tokens]
    whole = [not p or (p[0] & 0xC0) != 0x80 for p in parts]
    blank = [p[:1].isspace() for p in parts]
    out, a, char = [], 0, 0
    while a < len(tokens):
        b = min(len(tokens), a + capacity)
        if b < len(tokens):
            c = next((i for i in range(b, a, -1) if blank[i] and whole[i]), None) or next((i for i in range(b, a, -1) if whole[i]), b)
            b = c if c > a else b
        n = len(b"".join(parts[a:b]).decode("utf-8", "ignore"))
        out.append((b - a, char, char + n))
        a, char = b, char + n
    out[-1] = (out[-1][0], out[-1][1], len(text))
    return out


def sized_pieces(docs: DataFrame, capacity: int, path: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each text, and its pieces if they exceed ``capacity``; one pass without a shuffle.

    Null and empty texts have no tokens and give one row with n_tokens 0.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cuts = pieces(t or "", path, capacity)
                rows += [(d, i, len(cuts), *c) for i, c in enumerate(cuts)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SIZES.split(", ")])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(measure, SIZES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of the bounds that dual feasible functions give."""
    return bound_of_counts(*np.unique(sizes.astype(np.int64), return_counts=True), capacity)


def bound_of_counts(x: np.ndarray, n: np.ndarray, capacity: int) -> int:
    """The bound for ``n`` pieces of each of the sizes ``x``, which are distinct and in order."""
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 21):  # rounds sizes down to multiples of 1/k, exact multiples of 1/(k+1) kept
        m, rest = np.divmod((k + 1) * x, capacity)
        best = max(best, -(-int((np.where(rest == 0, m * k, m * (k + 1)) * n).sum()) // (k * (k + 1))))
    low = np.unique(np.concatenate([x[2 * x <= capacity], capacity - x[2 * x > capacity]]))  # large ones count whole, small ones not
    tokens, count = (np.concatenate([[0], np.cumsum(v)]) for v in (x * n, n))  # of the first so many sizes
    small, whole = np.searchsorted(x, low), np.searchsorted(x, capacity - low, side="right")
    return max(best, -(-int((tokens[whole] - tokens[small] + capacity * (count[-1] - count[whole])).max()) // capacity))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing: the container number of each size, and how many there are."""
    at = np.zeros(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    mask = n = 0  # bit r: some container has r tokens of room
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        over = mask >> s
        if over:
            room = s + (over & -over).bit_length() - 1
            bins = free[room]
            b = bins.pop()
            if not bins:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        at[i] = b
        left = room - s
        if left:
            free.setdefault(left, []).append(b)
            mask |= 1 << left
    return at, n


def _pack(capacity: int, round_no: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_ix"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy()
        at, n = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        used = np.bincount(at, weights=sizes, minlength=n)
        # the emptiest container of each group, and in a group above its bound every one with more room than the
        # average, gives its pieces to the next round
        room = capacity - used
        again = ((room > 0) & (room == room.max()) | (n > bound) & (room >= max(1.0, float(room.mean()))))[at]
        out = pdf.drop(columns=["grp"])
        out["container_id"] = [f"{round_no}-{key[0]}-{b}" for b in at]
        out["bins"], out["bound"] = n, bound
        out["again"] = again
        return out

    return pack


def pack_documents(docs: DataFrame, capacity: int, path: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Each text, or each piece of a text over ``capacity`` tokens, with the container that holds it.

    Pieces are hashed into groups of about ``GROUP_ITEMS`` and each group is packed best fit decreasing.
    The dual-feasible-function bound of the group certifies its number of containers; groups above it give up
    their emptier containers, and every group its emptiest one; their pieces are mixed across groups and packed again,
    ``rounds`` times or until one group is left.
    Columns ``bins`` and ``bound``: containers and lower bound of the group that placed the piece.

    Null and empty texts take no room: they come out with a null container. Rows delivered twice (same id and
    text) are packed once. The texts are read once and never shuffled; only sizes move.
    """
    sized = cut(sized_pieces(docs, capacity, path, doc_id, text))
    items = sized.where("n_tokens > 0").dropDuplicates(["doc_id", "piece_ix", "n_tokens", "char_start"])
    total = sized.where("n_tokens > 0").count()
    schema = PACKED + ", again boolean"
    done = []
    for no in range(rounds + 1):
        groups = max(1, -(-total // GROUP_ITEMS))
        grp = F.pmod(F.xxhash64("doc_id", "piece_ix", F.lit(no)), F.lit(groups))
        packed = items.select("doc_id", "piece_ix", "n_pieces", "n_tokens", "char_start", "char_end", grp.alias("grp")).groupBy("grp").applyInPandas(_pack(capacity, no), schema)
        packed = cut(packed)
        total = packed.where("again").count() if no < rounds and groups > 1 else 0
        done.append(packed.where("not again") if total else packed)
        if not total:
            break
        items = packed.where("again")
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    empty = sized.where("n_tokens = 0").select("doc_id").distinct().select(F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece_ix"), F.lit(1).alias("n_pieces"), F.lit(0).alias("n_tokens"), F.lit(0).cast("bigint").alias("char_start"), F.lit(0).cast("bigint").alias("char_end"), F.lit(None).cast("int").alias("bins"), F.lit(None).cast("int").alias("bound"))
    return out.drop("again").unionByName(empty)


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers used, the least any packing of these pieces needs (by tokens alone, and certified), and the share of room left unused.

    The certified bound is that of ``lower_bound`` over all pieces, worked out from their counts per size, at most ``capacity`` rows.
    """

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"n_tokens": [], "n": []}), *frames]).astype("int64").sort_values("n_tokens")
        yield pd.DataFrame({"certified": [bound_of_counts(got["n_tokens"].to_numpy(), got["n"].to_numpy(), capacity)]})

    placed = packed.where("container_id is not null")
    sizes = placed.groupBy("n_tokens").agg(F.count("*").alias("n"))
    boxes = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    out = boxes.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"), F.coalesce(F.sum("used"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / F.lit(capacity)).cast("bigint").alias("least_containers"),
        F.max("used").cast("bigint").alias("fullest"), F.round(1 - F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("unused_share"),
    )
    certified = sizes.repartition(1).mapInPandas(bound, "certified bigint")
    return out.join(F.broadcast(certified), F.lit(True), "left").select("*", F.coalesce("certified", F.lit(0)).alias("certified_containers")).drop("certified")  # one row each


def container_capacity(limits: DataFrame) -> int:
    """The capacity in ``size_limit`` (one row; the smallest if there are several)."""
    row = limits.where("applies_to = 'container' and max_size > 0").agg(F.min("max_size").alias("m")).first()
    if row["m"] is None:
        raise ValueError("size_limit names no container capacity")
    return int(row["m"])
