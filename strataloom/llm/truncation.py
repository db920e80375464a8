"""Problem 4: values that lost their end, by prefixes of longer copies and by how complete values end."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.plans.checkpoints import cut
from strataloom.plans.skew import HOT_ROWS, count_join

FIELDS = ("shortdesc", "body_xml")
#: Elements whose text is made of sentences; others (list items, cells, titles) may end without a stop.
PROSE_TAGS = ("p", "cmd", "shortdesc", "note", "context", "result", "info", "prereq", "stepresult")
#: A length is a limit where it has this many times the cut values that lengths near it (so many to either side) usually have.
LIMIT_TIMES, LIMIT_NEAR = 5, 20
#: Where the median is small, chance alone gives some lengths several values: the median counts as so many more.
LIMIT_CHANCE = 1.5

_MARK = r"(?:…|\.\.\.|�|\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\))\s*$"
_STOP = r"[.!?。！？][\"'”’»)\]]*\s*$"


def _balanced(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^(]", "")) <= F.length(F.regexp_replace(text, r"[^)]", ""))


def _ends(text: Column) -> Column:
    """Does the text end like a complete sentence: a stop, no mark of a cut, no bracket left open?"""
    return text.rlike(_STOP) & ~text.rlike(_MARK) & _balanced(text)


def _letter(char: str) -> bool:
    return unicodedata.category(char)[0] in "LM"


def neighbours(values: DataFrame, column: str = "value") -> DataFrame:
    """(value, inside): each distinct value that a longer one begins with; does any such one go on with a letter?

    The distinct values are range-partitioned and sorted, so equal prefixes, however many, spread over partitions. All
    values that begin with one value follow it directly, so a stack of the values that the present one begins with finds
    them; only the nearest needs to be told of it, as the others go on alike with that one. Between partitions go the
    stack at the end and, for each prefix of a partition's first value, whether any value there goes on from it with a letter.
    """
    distinct = values.select(F.col(column).alias("value")).distinct()
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = distinct.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["value", "inside", "letters", "part", "kind"]
        first, letters, part = None, [], 0
        stack: list[list] = []  # [value, is continued, inside]
        for pdf in frames:
            rows = []
            for v in pdf["value"]:
                if first is None:
                    first, letters, part = v, [_letter(c) for c in v], int(pdf["part"].iloc[0])
                shared = len(commonprefix((first, v)))
                if shared < min(len(first), len(v)) and _letter(v[shared]):
                    letters[shared] = True
                while stack and not v.startswith(stack[-1][0]):
                    value, continued, inside = stack.pop()
                    if continued:
                        rows.append((value, inside, None, part, "pair"))
                if stack:
                    top = stack[-1]
                    top[1], top[2] = True, top[2] or _letter(v[len(top[0])])
                stack.append([v, False, False])
            yield pd.DataFrame(rows, columns=columns)
        if first is not None:
            rows = [(first, None, "".join("01"[x] for x in letters), part, "first")]
            # values that may go on in the next partition
            yield pd.DataFrame(rows + [(value, inside if continued else None, None, part, "open") for value, continued, inside in stack], columns=columns)

    def join_edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[list] = []  # [value, inside or None where nothing goes on yet]
        for pdf in frames:
            done = []
            for value, inside, letters, kind in zip(pdf["value"], pdf["inside"], pdf["letters"], pdf["kind"], strict=True):
                if kind == "first":
                    while waiting and not value.startswith(waiting[-1][0]):
                        done.append(waiting.pop())
                    for x in waiting:
                        x[1] = bool(x[1]) or letters[len(x[0])] == "1"
                else:
                    waiting.append([value, None if pd.isna(inside) else bool(inside)])
            yield pd.DataFrame([x for x in done if x[1] is not None], columns=["value", "inside"])
        yield pd.DataFrame([x for x in waiting if x[1] is not None], columns=["value", "inside"])

    got = cut(ordered.mapInPandas(scan, "value string, inside boolean, letters string, part int, kind string"))
    pairs = got.where("kind = 'pair'").select("value", "inside")
    # a few rows per partition, in one task: its first value, and the last one with those that it begins with
    edges = got.where("kind <> 'pair'").repartition(1).sortWithinPartitions("part", "kind", "value")
    return pairs.unionAll(edges.mapInPandas(join_edges, "value string, inside boolean"))


def sentence_odds(unknown: DataFrame, sentences: DataFrame, phrases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, odds): how much more the words of a text are those of sentences than those of phrases (titles).

    Case counts: words of titles are often capitalised. Word counts of both kinds are smoothed by one half.
    """

    def words(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, F.explode(F.regexp_extract_all("value", F.lit(r"([\p{L}\p{M}]+)"), 1)).alias("word"))

    a = words(sentences).groupBy("word").agg(F.count("*").alias("s"))
    b = words(phrases).groupBy("word").agg(F.count("*").alias("p"))
    stats = a.join(b, "word", "full").na.fill(0, ["s", "p"])
    totals = stats.agg((F.sum("s") + 0.5 * F.count("*")).alias("ts"), (F.sum("p") + 0.5 * F.count("*")).alias("tp"))
    mine = words(unknown, "id").groupBy("id", "word").agg(F.count("*").alias("n"))
    size = mine.groupBy("word").agg(F.count("*").alias("rows"))
    known = size.join(stats, "word")
    joined = count_join(mine, known, "word", "rows", F.col("id"), hot_rows).crossJoin(F.broadcast(totals))  # one row
    return joined.groupBy("id").agg(F.sum(F.col("n") * (F.log((F.col("s") + 0.5) / F.col("ts")) - F.log((F.col("p") + 0.5) / F.col("tp")))).alias("odds"))


def field_values(topic: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, field, value) of both fields, without null and blank ones; rows delivered twice once."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))
    rows = topic.select("doc_id", "topic_ix", F.explode(pairs).alias("x")).select("doc_id", "topic_ix", "x.field", "x.value")
    return rows.where(F.trim("value") != "").distinct()


def _endings(values: DataFrame) -> DataFrame:
    """What can be told of each value from its own end; the value itself only where it has no markup.

    Patterns are anchored at the start of the reversed text, so that they take linear time.
    """
    root = F.regexp_extract("value", r"^\s*<([A-Za-z][\w.-]*)", 1)
    back = F.regexp_replace(F.reverse("value"), r"^\s+", "")
    closers = F.regexp_extract("back", r"^((?:\s*>[\w.-]+/<)+)", 1)
    v = values.select("doc_id", "topic_ix", "field", "value", root.alias("root"), back.alias("back"))
    v = v.select("*", (F.col("root") != "").alias("xml"), F.startswith("back", F.reverse(F.concat(F.lit("</"), F.col("root"), F.lit(">")))).alias("closed"), closers.alias("closers"))
    bare = F.expr("substring(back, length(closers) + 1)")
    v = v.select("*", F.when(F.col("xml"), F.reverse(F.regexp_extract(bare, "^([^<>]*)", 1))).otherwise(F.col("value")).alias("tail"), F.regexp_extract(F.reverse("closers"), r"^</([\w.-]+)>", 1).alias("tag"))
    short = F.expr("reverse(substring(back, 1, 16))")  # a mark is a few characters
    marked = F.when(F.col("xml") & ~F.col("closed"), short.rlike(_MARK)).otherwise(F.col("tail").rlike(_MARK))
    v = v.select("*", _ends(F.col("tail")).alias("ends"), marked.alias("marked"), (~F.col("xml") | F.col("tag").isin(*PROSE_TAGS)).alias("prose"), F.length("value").alias("n_chars"))
    sure = (
        F.when(F.col("marked"), "mark")
        .when(F.col("xml") & ~F.col("closed"), "open")
        .when(F.col("prose") & F.col("tail").rlike(_STOP) & ~_balanced(F.col("tail")), "open")
    )
    return v.select("doc_id", "topic_ix", "field", F.xxhash64("value").alias("id"), F.when(~F.col("xml"), F.col("value")).alias("value"), "xml", "ends", "prose", (F.trim("tail") != "").alias("said"), "n_chars", sure.alias("sure"))


def limit_lengths(cut_values: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_chars, at): lengths at which cut values pile up, with how many are cut there.

    Cuts by chance (a transfer that broke off) lie on every length, the more the larger the input; so a length is held
    against the median of the lengths near it, those without a cut value included: below or above it, whichever is more, as
    values may have a longest length. ``LIMIT_CHANCE`` is added to that median, for the chance of few values. Rows here are one per
    length and length near it, however many the values are.
    """
    at = cut_values.groupBy(*keys, "n_chars").agg(F.count("*").alias("at"))
    moved = at.select(*keys, F.explode(F.sequence(F.col("n_chars") - LIMIT_NEAR, F.col("n_chars") + LIMIT_NEAR)).alias("_n"), F.signum(F.col("n_chars") - F.col("_n")).alias("side"), "at")

    def of(side: int) -> Column:
        return F.when(F.col("side") == side, F.col("at"))

    def median(counts: str, lengths: Column) -> Column:
        return F.coalesce(F.get(counts, F.floor(lengths / 2).cast("int")), F.lit(0))

    near = moved.groupBy(*keys, F.col("_n").alias("n_chars")).agg(F.max(of(0)).alias("at"), *(F.sort_array(F.collect_list(of(k)), asc=False).alias(name) for k, name in ((-1, "below"), (1, "above"))))
    usual = F.greatest(median("below", F.least(F.col("n_chars") - 1, F.lit(LIMIT_NEAR))), median("above", F.lit(LIMIT_NEAR)))
    return near.where("at is not null").where(F.col("at") >= LIMIT_TIMES * (usual + LIMIT_CHANCE)).select(*keys, "n_chars", "at")


def truncated_values(topic: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, field, n_chars, reason) of the values that lost their end.

    Reasons, in this order:
    ``mark``: an ellipsis or replacement character stands at the end (or before the closing tags) as put after a cut;
    ``open``: markup whose root element is not closed, or a bracket left open before a stop;
    ``prefix``: the value stops inside a word at which a longer value elsewhere goes on, or it stops at its
    field's length limit and a longer value goes on;
    ``sentence``: the value (or the last prose element of a closed body) is a sentence without its end.

    A phrase without a stop (its words are rather those of titles than of sentences) and a closed body, whatever
    slips its markup has, are complete. Null, blank and missing values have no rows. Extra columns are ignored.
    """
    v = cut(_endings(field_values(topic)))  # read five times below; bodies stay behind
    # texts without markup that do not end like sentences: sentences cut short, or complete phrases
    loose = v.where("sure is null and not xml and not ends").select("id", "value").distinct()
    sentences = v.where("not xml and ends").select("value")
    phrases = topic.where("title is not null").select(F.col("title").alias("value"))
    odds = sentence_odds(loose, sentences, phrases)
    # the prefix self-join, on all values without markup (markup that stops before its end is never closed)
    near = neighbours(v.where("not xml"))
    near = near.select(F.xxhash64("value").alias("_id"), (F.col("inside") & F.col("value").rlike(r"[\p{L}\p{M}]$")).alias("inside"))
    v = v.join(odds, "id", "left").join(near, F.col("id") == F.col("_id"), "left")
    reason = (
        F.when(F.col("sure").isNotNull(), F.col("sure"))
        .when(~F.col("xml") & F.col("inside") & ~F.col("ends"), "prefix")
        .when(F.col("xml") & F.col("prose") & ~F.col("ends") & F.col("said"), "sentence")
        .when(~F.col("xml") & ~F.col("ends") & (F.coalesce("odds", F.lit(0.0)) > 0), "sentence")
    )
    v = cut(v.select("doc_id", "topic_ix", "field", "n_chars", "ends", "inside", reason.alias("reason")))
    # complete-looking values that a longer one continues, at a length at which the field's values are cut
    limits = limit_lengths(v.where("reason is not null"), "field").select(F.col("field").alias("_f"), F.col("n_chars").alias("_n"))
    doubtful = v.where("reason is null and inside is not null and ends").select("doc_id", "topic_ix", "field", "n_chars")
    at_limit = doubtful.join(limits, (F.col("field") == F.col("_f")) & (F.col("n_chars") == F.col("_n"))).select("doc_id", "topic_ix", "field", "n_chars", F.lit("prefix").alias("reason"))
    return v.where("reason is not null").select("doc_id", "topic_ix", "field", "n_chars", "reason").unionAll(at_limit)


def cut_rates(topic: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, field, n_values, n_cut, cut_rate, limit_chars): how often each source cuts, and at which length most.

    ``limit_chars`` is the commonest length at which the source's cut values pile up, null where they do at none.
    """
    meta = docs.select("doc_id", "source").where("source is not null").dropDuplicates(["doc_id"])
    every = field_values(topic).select("doc_id", "topic_ix", "field").distinct().join(meta, "doc_id").groupBy("source", "field").agg(F.count("*").alias("n_values"))
    bad = truncated_values(topic).groupBy("doc_id", "topic_ix", "field").agg(F.min("n_chars").alias("n_chars")).join(meta, "doc_id")
    bad = cut(bad.select("source", "field", "n_chars"))  # read twice below
    top = bad.groupBy("source", "field").agg(F.count("*").alias("n_cut"))
    limit = limit_lengths(bad, "source", "field").groupBy("source", "field").agg(F.max(F.struct("at", "n_chars")).alias("m"))
    out = every.join(top, ["source", "field"], "left").join(limit, ["source", "field"], "left")
    return out.select("source", "field", "n_values", F.coalesce("n_cut", F.lit(0)).cast("bigint").alias("n_cut"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_values"), 6).alias("cut_rate"), F.col("m.n_chars").alias("limit_chars"))
