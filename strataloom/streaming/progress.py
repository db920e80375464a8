"""Run progress as streams of stage events: newest stage per client, windows, expiry, event-stream text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.plans.checkpoints import ensure_checkpoint_dir

EVENT_SCHEMA = "client_id string, name string, status string, time double, detail string, ts timestamp"
#: Silence after which a client's state is dropped, and how late events may come.
EXPIRY = "1 hour"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of stage events from the parquet files that land in the folder ``path``, or from the one file ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", target.getName()).parquet(str(target.getParent()))


def latest_stages(stream: DataFrame, lateness: str = EXPIRY) -> DataFrame:
    """Newest row of each client and stage (update mode); late rows never replace newer ones."""
    row = F.struct("ts", F.coalesce("status", F.lit("")).alias("s"), F.coalesce("time", F.lit(-1.0)).alias("t"))
    g = stream.withWatermark("ts", lateness).groupBy("client_id", "name").agg(F.max_by(F.struct("status", "time", "ts"), row).alias("m"))
    return g.select("client_id", "name", "m.status", "m.time", "m.ts")


def once_per_stage(stream: DataFrame, lateness: str = EXPIRY) -> DataFrame:
    """One done event of each client and stage within the watermark, as soon as it comes."""
    return stream.where("status = 'done'").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["client_id", "name"])


def first_done(stream: DataFrame) -> DataFrame:
    """(client_id, name, first_done): when each stage of a client was first done, whatever the order of the events."""
    return stream.where("status = 'done'").groupBy("client_id", "name").agg(F.min("ts").alias("first_done"))


def windowed_counts(stream: DataFrame, size: str = "10 minutes", slide: str | None = None, lateness: str = EXPIRY) -> DataFrame:
    """Events and seconds per window and stage; late events count as long as the watermark allows (in complete mode always)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", lateness).groupBy(w.alias("w"), "name").agg(F.count("*").alias("n"), F.sum("time").alias("seconds"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "name", "n", "seconds")


def sessions(stream: DataFrame, gap: str = EXPIRY, lateness: str = EXPIRY) -> DataFrame:
    """Sessions of clients, ended by ``gap`` of silence."""
    g = stream.withWatermark("ts", lateness).groupBy("client_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("client_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


SNAPSHOT = "client_id string, stages int, done int, active string, ended boolean"
#: How long a client's finished run can still be asked for.
GRACE_MS = 5_000


class Run:
    """The stages of one client's run, brought up to date by its events in order of time."""

    def __init__(self, state: dict[str, tuple[str, int]], expiry_us: int | None, grace_us: int):
        self.stages, self.expiry_us, self.grace_us = state, expiry_us, grace_us

    def newest(self) -> int:
        return max((t for _, t in self.stages.values()), default=0)

    def open(self) -> list[tuple[int, str]]:
        return sorted((t, n) for n, (s, t) in self.stages.items() if s not in ("done", "error"))

    def kept_until(self) -> int | None:
        """When the run is forgotten: shortly after its last stage was done, after the expiry otherwise; None is never."""
        if self.expiry_us is None or not self.stages:
            return None
        return self.newest() + (self.expiry_us if self.open() else self.grace_us)

    def add(self, name: str, status: str, t: int) -> None:
        until = self.kept_until()
        if until is not None and t > until:
            self.stages.clear()
        old = self.stages.get(name)
        if old is None or (t, status) >= (old[1], old[0]):
            self.stages[name] = (status, t)
        if status == "error" and self.expiry_us is not None:  # a run that failed is forgotten at once
            self.stages.clear()


def snapshots(stream: DataFrame, lateness: str = EXPIRY, expiry_ms: int | None = 3_600_000, grace_ms: int = GRACE_MS) -> DataFrame:
    """One snapshot per client and trigger: stages seen, stages done, the newest open one, and whether the run ended.

    Custom state per client: dropped ``grace_ms`` after the last stage was done, at once on an error, and ``expiry_ms`` after the newest
    event otherwise, all by event time; an event after that begins a new run. With ``expiry_ms`` None, stages are kept for ever.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], 0, 0, None, True)], columns=[c.split()[0] for c in SNAPSHOT.split(", ")])
            return
        held = zip(*state.get, strict=True) if state.exists else ()
        run = Run({n: (s, t) for n, s, t in held}, None if expiry_ms is None else expiry_ms * 1000, grace_ms * 1000)
        rows = [(r.ts.value // 1000, r.status or "", r.name) for pdf in frames for r in pdf.itertuples(index=False) if not pd.isna(r.ts)]
        for t, status, name in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "")):
            run.add(name, status, t)
        names = sorted(run.stages, key=lambda n: n or "")
        until = run.kept_until()
        if names:
            state.update((names, [run.stages[n][0] for n in names], [run.stages[n][1] for n in names]))
            if until is not None:
                state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        waiting = run.open()
        done = sum(s == "done" for s, _ in run.stages.values())
        yield pd.DataFrame([(key[0], len(names), done, waiting[-1][1] if waiting else None, not waiting)], columns=[c.split()[0] for c in SNAPSHOT.split(", ")])

    return stream.withWatermark("ts", lateness).groupBy("client_id").applyInPandasWithState(step, SNAPSHOT, "names array<string>, statuses array<string>, times array<bigint>", "update", "EventTimeTimeout")


def poll(latest: DataFrame, clients: DataFrame) -> DataFrame:
    """The newest snapshot of each asked client; one that nothing is known of has no stages and nothing active."""
    got = clients.select("client_id").distinct().join(latest, "client_id", "left")
    return got.select("client_id", F.coalesce("stages", F.lit(0)).alias("stages"), F.coalesce("done", F.lit(0)).alias("done"), "active", F.coalesce("ended", F.lit(True)).alias("ended"))


def event_stream_text(lines: DataFrame, key: str = "key", order: str = "n", line: str = "line") -> DataFrame:
    """(key, text, error) of server-sent event lines in order.

    Only lines that start with ``data:`` count; bad JSON is skipped; text parts are joined; the first error message is
    kept beside the text before it.
    """
    schema = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>, error struct<message: string>"
    data = lines.where(F.startswith(line, F.lit("data:"))).select(key, order, F.from_json(F.trim(F.substring(line, 6, 1_000_000_000)), schema).alias("e"))
    parts = F.flatten(F.transform(F.coalesce("e.candidates", F.array()), lambda c: F.transform(F.coalesce(c["content"]["parts"], F.array()), lambda p: p["text"])))
    g = data.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.array_join(parts, "").alias("t")))).alias("p"), F.min(F.when(F.col("e.error").isNotNull(), F.struct(order, "e.error.message"))).alias("x"))
    return g.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), F.col("x.message").alias("error"))


def run_to_table(stream: DataFrame) -> DataFrame:
    """All of an append-mode stream that is available now, written below the shared checkpoint folder and read again."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_totals(stream: DataFrame) -> DataFrame:
    """The final rows of an aggregated stream over all that is available now, as a batch over the same data gives them.

    Complete mode keeps every group, so neither groups that the watermark has not passed nor late rows are lost, however
    the data are divided into triggers. Each trigger writes its totals over those of the one before.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
    # written once without rows, for data without any trigger
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out")

    def keep(totals: DataFrame, _: int) -> None:
        totals.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_latest(stream: DataFrame, key: str) -> DataFrame:
    """The newest row per ``key`` of an update-mode stream over all that is available now; each trigger appends its rows."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
    schema = stream.withColumn("_trigger", F.lit(0).cast("bigint")).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/trigger=-1")

    def keep(rows: DataFrame, number: int) -> None:  # a trigger that runs again replaces its own rows
        rows.withColumn("_trigger", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/trigger={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_trigger").alias("m")).select(key, "m.*")
