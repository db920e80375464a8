"""Analytics of runs: stages, summaries, checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages of a run in order, and the step of the progress view that shows each.
STAGES = ("parse", "group", "plan", "classify", "emit", "validate")
VIEW_STEPS = {"parse": "ingest", "group": "normalize", "plan": "detect", "classify": "transform", "emit": "export", "validate": "validate"}


def latest_stages(events: DataFrame) -> DataFrame:
    """(client_id, name, status, time, ts): the newest row of each client and stage; of equal times the greatest row."""
    row = F.struct("ts", F.coalesce("status", F.lit("")).alias("s"), F.coalesce("time", F.lit(-1.0)).alias("t"))
    g = events.groupBy("client_id", "name").agg(F.max_by(F.struct("status", "time", "ts"), row).alias("m"))
    return g.select("client_id", "name", "m.status", "m.time", "m.ts")


def active_stage(latest: DataFrame) -> DataFrame:
    """(client_id, active): the first stage in order that is neither done nor failed; null if there is none."""
    order = F.array(*map(F.lit, STAGES))
    at = F.array_position(order, F.col("name"))
    open_ = ~F.coalesce(F.col("status"), F.lit("")).isin("done", "error")
    return latest.where(at > 0).groupBy("client_id").agg(F.min(F.when(open_, F.struct(at.alias("at"), "name"))).alias("m")).select("client_id", F.col("m.name").alias("active"))


def stage_view(latest: DataFrame) -> DataFrame:
    """Latest stages with the step of the view that shows them; unknown stages are left out. The map is a literal."""
    steps = F.create_map(*(F.lit(x) for kv in VIEW_STEPS.items() for x in kv))
    return latest.withColumn("step", F.element_at(steps, F.col("name"))).where("step is not null")


def run_summary(events: DataFrame) -> DataFrame:
    """(client_id, stages, done, failed, seconds): distinct events of each client; pre-aggregated before the shuffle."""
    return events.groupBy("client_id").agg(F.count("*").alias("stages"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("failed"), F.sum(F.coalesce("time", F.lit(0.0))).alias("seconds"))


def history(runs: DataFrame, last: int = 10) -> DataFrame:
    """The newest runs, newest first: a top-k report."""
    return runs.orderBy(F.desc("ts"), "client_id", "name").limit(last)


def type_summary(topic_types: DataFrame) -> DataFrame:
    """(doc_id, summary) such as "concept x2, task x1"."""
    g = topic_types.groupBy("doc_id").pivot("topic_type", ["concept", "task", "reference"]).count().na.fill(0)
    parts = [F.when(F.col(t) > 0, F.concat(F.lit(f"{t} x"), F.col(t).cast("string"))) for t in ("concept", "task", "reference")]
    return g.select("doc_id", F.concat_ws(", ", *parts).alias("summary"))


def checklist(texts: DataFrame, maps: DataFrame, images: DataFrame, group: str, xml: str = "xml") -> DataFrame:
    """(group, place, feature, status): the features a to k of each group with topics, in the order of their letters.

    ``texts`` and ``maps`` are (group, xml), ``images`` the (group, ok, bad) of ``image_cap_audit``. Counts are made per table before they are joined.
    """
    t = F.coalesce(F.col(xml), F.lit(""))

    def count(pattern: str) -> Column:
        return F.sum(F.regexp_count(t, F.lit(pattern)))

    g = texts.groupBy(group).agg(
        F.count("*").alias("topics"), F.count_if(t.rlike(r"<(concept|task|reference)\s")).alias("typed"), F.count_if(t.rlike(r"<tgroup\b")).alias("tables"),
        count(r"\b(?:via|i\.e\.|e\.g\.|etc\.)").alias("abbreviations"), count(r"<shortdesc\b").alias("shortdescs"), count(r"<keywords class=").alias("keywords"),
        count(r"<xref\b").alias("xrefs"), count(r"<image\b").alias("images"), count(r"<alt\b").alias("alts"),
    )
    m = maps.groupBy(group).agg(F.count_if(t != "").alias("maps"), F.sum(F.regexp_count(t, F.lit('keys="product-name"'))).alias("products"))
    i = images.groupBy(group).agg(F.sum(F.col("ok") + F.col("bad")).alias("measured"))
    g = g.join(m, group, "left").join(i, group, "left").na.fill(0, ["maps", "products", "measured"])
    passes = {
        "a": (F.col("typed") > 0, "fail"), "b": (F.col("maps") > 0, "fail"), "c": (F.col("tables") > 0, "warn"), "d": (F.col("abbreviations") == 0, "fail"),
        "e": (F.col("shortdescs") == F.col("topics"), "warn"), "f": (F.col("products") > 0, "warn"), "g": (F.col("keywords") == F.col("topics"), "warn"), "h": (F.col("xrefs") > 0, "warn"),
        "i": (F.col("measured") > 0, "warn"), "j": ((F.col("images") > 0) & (F.col("alts") == F.col("images")), F.when(F.col("images") == 0, "warn").otherwise("fail")), "k": (F.lit(True), "fail"),
    }
    cells = F.array(*(F.struct(F.lit(n + 1).alias("place"), F.lit(k).alias("feature"), F.when(ok, "pass").otherwise(other).alias("status")) for n, (k, (ok, other)) in enumerate(passes.items())))
    return g.select(group, F.inline(cells))


def domain_ranks(names: DataFrame, name: str = "domain") -> DataFrame:
    """(name, n, place): domain elements, the most frequent first, equal ones by name; there are as many rows as element names."""
    g = names.groupBy(name).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), name)))


#: Limits of an image, and the qualities tried in turn until it keeps the size limit.
IMAGE_WIDTH, IMAGE_BYTES = 1000, 204_800
QUALITIES = (85, 75, 65, 55, 45)


def image_work(images: DataFrame, width: int = IMAGE_WIDTH, size: int = IMAGE_BYTES) -> DataFrame:
    """``images`` (name, width, bytes, ...) with what keeps them within the limits: ``new_width`` (null: as it is), ``recode``, ``new_name``.

    Only images that break a limit are touched. PNG files over the size limit become JPEG under a new name; unreadable ones (null width) stay.
    """
    heavy = F.coalesce(F.col("bytes") > size, F.lit(False)) & F.col("width").isNotNull()
    png = F.lower("name").rlike(r"\.png$")
    return images.select(
        "*", F.when(F.col("width") > width, width).alias("new_width"), heavy.alias("recode"),
        F.when(heavy & png, F.regexp_replace("name", r"(?i)\.png$", ".jpg")).otherwise(F.col("name")).alias("new_name"),
    )


def image_cap_audit(images: DataFrame, width: int = IMAGE_WIDTH, size: int = IMAGE_BYTES) -> DataFrame:
    """(doc_id, ok, bad) of images (doc_id, width, bytes) against the caps; unreadable ones (null) do not count."""
    ok = (F.col("width") <= width) & (F.col("bytes") <= size)
    return images.where("width is not null and bytes is not null").groupBy("doc_id").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))


def error_lines(logs: DataFrame, line: str = "line") -> DataFrame:
    """Log lines that hold a coded error or failure."""
    return logs.where(F.contains(line, F.lit("[DOT")) & (F.contains(line, F.lit("E]")) | F.contains(line, F.lit("F]"))))


def run_stats(sections: DataFrame, topics: DataFrame, files: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """(doc_id, sections, topics, files, failed): what a run made of each document; counts are made before the joins.

    ``valid`` (doc_id, valid) is optional; without it no file counts as failed.
    """
    s = sections.groupBy("doc_id").agg(F.count("*").alias("sections"))
    t = topics.groupBy("doc_id").agg(F.count("*").alias("topics"))
    f = files.groupBy("doc_id").agg(F.count("*").alias("files"))
    out = s.join(t, "doc_id", "full").join(f, "doc_id", "full")
    if valid is not None:
        out = out.join(valid.groupBy("doc_id").agg(F.count_if(~F.col("valid")).alias("failed")), "doc_id", "left")
    else:
        out = out.withColumn("failed", F.lit(0).cast("bigint"))
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("sections", "topics", "files", "failed")))
