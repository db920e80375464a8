"""Element tables of markup, and the metrics that compare actual with expected topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import f1, markup_text, strip_doctype, word_set
from strataloom.operators.xmltree import well_formed

DOMAINS = ("ui-d", "pr-d", "hi-d", "sw-d")
SEMANTIC = ("ui-d:uicontrol", "ui-d:menucascade", "ui-d:wintitle", "pr-d:codeblock", "pr-d:option")


def element_rows(files: DataFrame, keys: list[str], xml: str) -> DataFrame:
    """(keys, node_ix, tag, class, closes, empty) of the tags of each file, by text alone, so that broken markup counts too."""
    bare = F.regexp_replace(strip_doctype(F.col(xml)), r"(?s)<\?.*?\?>|<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    x = files.where(F.col(xml).isNotNull()).select(*keys, F.posexplode(F.regexp_extract_all(bare, F.lit(r"<(/?[A-Za-z_][^<>]*)>"), 1)).alias("node_ix", "t"))
    name = F.regexp_extract("t", r"^/?([A-Za-z_][A-Za-z0-9_.:-]*)", 1)
    return x.select(*keys, "node_ix", name.alias("tag"), F.nullif(F.regexp_extract("t", r'\bclass="([^"]*)"', 1), F.lit("")).alias("class"), F.startswith("t", F.lit("/")).alias("closes"), F.endswith("t", F.lit("/")).alias("empty"))


def depths(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Opening tags with ``depth``, 0 for the root: opened minus closed before, never below 0."""
    w = Window.partitionBy(*keys).orderBy("node_ix").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("closes"), -1).when(F.col("empty"), 0).otherwise(1)
    return nodes.withColumn("depth", F.greatest(F.coalesce(F.sum(step).over(w), F.lit(0)), F.lit(0))).where(~F.col("closes"))


def element_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tag, n): elements by name, and by domain and name for classes of DOMAINS."""
    opened = nodes.where(~F.col("closes"))
    names = [F.concat(F.lit(f"{d}:"), F.nullif(F.regexp_extract("class", rf"{d}/([A-Za-z0-9_]+)", 1), F.lit(""))) for d in DOMAINS]
    rows = opened.select(*keys, F.explode(F.array_compact(F.array("tag", *names))).alias("tag"))
    return rows.groupBy(*keys, "tag").agg(F.count("*").alias("n"))


def class_coverage(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, with_class, coverage) of each file, and of all files in a row with null keys."""
    opened = nodes.where(~F.col("closes"))
    g = opened.rollup(*keys).agg(F.count("*").alias("total"), F.count("class").alias("with_class"), F.grouping_id().alias("_g"))
    return g.where(F.col("_g").isin(0, 2 ** len(keys) - 1)).select(*keys, "total", "with_class", (F.col("with_class") / F.greatest("total", F.lit(1))).alias("coverage"))


def structural_f1(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, common, expected, actual, f1): overlap of the (depth, tag) multisets."""
    e = depths(expected, keys).groupBy(*keys, "depth", "tag").agg(F.count("*").alias("e"))
    a = depths(actual, keys).groupBy(*keys, "depth", "tag").agg(F.count("*").alias("a"))
    j = e.join(a, [*keys, "depth", "tag"], "full").na.fill(0, ["e", "a"])
    g = j.groupBy(*keys).agg(F.sum(F.least("e", "a")).alias("common"), F.sum("e").alias("expected"), F.sum("a").alias("actual"))
    p, r = F.col("common") / F.greatest("actual", F.lit(1)), F.col("common") / F.greatest("expected", F.lit(1))
    return g.withColumn("f1", f1(p, r))


def word_f1(expected: Column, actual: Column) -> dict[str, Column]:
    """Precision, recall and F1 of the word sets of two markup texts."""
    e, a = word_set(markup_text(expected)), word_set(markup_text(actual))
    common = F.size(F.array_intersect(e, a))
    p, r = common / F.greatest(F.size(a), F.lit(1)), common / F.greatest(F.size(e), F.lit(1))
    return {"precision": p, "recall": r, "f1": f1(p, r)}


def semantic_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(matched, total, score): SEMANTIC elements that occur in what is expected, and of those the ones in what is actual."""
    counts = expected.where(F.col("tag").isin(*SEMANTIC)).select("tag", F.col("n").alias("e"), F.lit(0).alias("a")).unionAll(actual.where(F.col("tag").isin(*SEMANTIC)).select("tag", F.lit(0), "n"))
    per = counts.groupBy("tag").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    return per.agg(F.count_if((F.col("e") > 0) & (F.col("a") > 0)).alias("matched"), F.count_if(F.col("e") > 0).alias("total")).withColumn("score", F.col("matched") / F.greatest("total", F.lit(1)))


def map_score(refs_equal: Column, keys_equal: Column, has_title: Column) -> Column:
    return (refs_equal.cast("int") + keys_equal.cast("int") + has_title.cast("int")) / F.lit(3.0)


def map_metrics(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, refs_equal, keys_equal, has_title, score) of pairs of maps: as many references, the same set of keys, a title in the actual one."""

    def read(df: DataFrame, side: str) -> DataFrame:
        names = F.array_sort(F.array_distinct(F.regexp_extract_all("xml", F.lit(r'<keydef\b[^>]*?\bkeys="([^"]*)"'), 1)))
        return df.select(*keys, F.regexp_count("xml", F.lit(r"<topicref\b")).alias(f"{side}_refs"), names.alias(f"{side}_keys"), F.col("xml").rlike(r"<title\b").alias(f"{side}_title"))

    j = read(expected, "e").join(read(actual, "a"), keys)
    j = j.select(*keys, (F.col("e_refs") == F.col("a_refs")).alias("refs_equal"), (F.col("e_keys") == F.col("a_keys")).alias("keys_equal"), F.col("a_title").alias("has_title"))
    return j.withColumn("score", map_score(F.col("refs_equal"), F.col("keys_equal"), F.col("has_title")))


#: The metrics of an evaluation, in the order of the report.
METRICS = ("well-formedness", "class coverage", "topic type", "structure", "semantic elements", "words", "map")


def evaluate(pairs: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    """(metric, score): all METRICS of pairs of files (keys, expected, actual), and of ``maps``, the rows of ``map_metrics``.

    Scores of files and maps are averaged; class coverage and semantic elements are counted over all files. A metric without anything
    to be measured is 0. Broken markup counts by its tags.
    """
    e, a = (element_rows(pairs, keys, side) for side in ("expected", "actual"))
    root = {side: F.regexp_extract(F.regexp_replace(strip_doctype(F.col(side)), r"(?s)<\?.*?\?>|<!--.*?-->", ""), r"<([A-Za-z_][\w.:-]*)", 1) for side in ("expected", "actual")}
    per_file = pairs.agg(
        F.avg(well_formed(strip_doctype(F.regexp_replace("actual", r"^\s*<\?xml[^>]*\?>", ""))).cast("int")).alias("well-formedness"), F.avg((root["expected"] == root["actual"]).cast("int")).alias("topic type"),
        F.avg(word_f1(F.col("expected"), F.col("actual"))["f1"]).alias("words"),
    )
    parts = [
        per_file, a.where(~F.col("closes")).agg((F.count("class") / F.count("*")).alias("class coverage")), structural_f1(e, a, keys).agg(F.avg("f1").alias("structure")),
        semantic_coverage(element_counts(e, keys), element_counts(a, keys)).select(F.col("score").alias("semantic elements")), maps.agg(F.avg("score").alias("map")),
    ]
    rows = [p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias("score")) for c in p.columns))).alias("m")).select("m.*") for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def report(metrics: DataFrame) -> DataFrame:
    """(place, line): the report of an evaluation, metrics in their order and the overall score last."""
    order = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric")).cast("int")
    overall = metrics.agg(F.avg("score").alias("score")).select(F.lit(len(METRICS) + 1).alias("place"), report_line(F.lit("overall"), F.col("score")).alias("line"))
    return metrics.select(order.alias("place"), report_line(F.col("metric"), F.col("score")).alias("line")).unionAll(overall)


def evaluation_json(metrics: DataFrame) -> DataFrame:
    """(json): overall score and all metrics, which are a handful of rows."""
    row = F.struct("metric", F.round("score", 4).alias("score"))
    g = metrics.agg(F.round(F.avg("score"), 4).alias("overall"), F.sort_array(F.collect_list(row)).alias("metrics"))
    return g.select(F.to_json(F.struct("overall", "metrics")).alias("json"))


def report_line(metric: Column, score: Column) -> Column:
    """One line of a report: mark, name, a bar of 20 cells, per cent."""
    pct = score * 100
    cells = F.floor(pct / 5).cast("int")
    mark = F.when(pct >= 90, "✓").when(pct >= 70, "~").otherwise("✗")
    return F.concat(mark, F.lit(" "), metric, F.lit(" "), F.repeat(F.lit("#"), cells), F.repeat(F.lit("."), 20 - cells), F.lit(" "), F.format_string("%.1f", pct), F.lit("%"))


def match_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, filename): one file per topic type, the last by name; other prefixes match nothing."""
    kind = F.when(F.startswith("filename", F.lit("c_")), "concept").when(F.startswith("filename", F.lit("t_")), "task").when(F.startswith("filename", F.lit("r_")), "reference").when(F.endswith("filename", F.lit(".ditamap")), "map")
    return files.withColumn("kind", kind).where("kind is not null").groupBy(*keys, "kind").agg(F.max("filename").alias("filename"))
