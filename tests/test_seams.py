"""Annotators, decoders, sinks, streams and the registry."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strataloom import annotators as A
from strataloom.queries import core
from strataloom.sources import files, sinks
from strataloom.sources.settings import read_settings
from strataloom.streaming import progress as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(core.queries()) > 90
    assert "flagship_topics" in core.queries()


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() == 3 and got.columns == ["topic_type", "topics", "sections", "blocks"]


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_runs_on_the_smallest_tables(spark, name):
    df = core.queries()[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_calls_are_spaced_and_tried_again():
    waits, tries = [], []

    def call(prompt):
        tries.append(prompt)
        if prompt == "b" and tries.count("b") < 3:
            raise A.CallError(429 if tries.count("b") == 1 else 503)
        if prompt == "bad":
            raise A.CallError(400)
        return prompt.upper()

    c = A.Calling(call, sleep=waits.append)
    assert list(c.answer(iter("ab"))) == ["A", "B"] and waits == [0.1, 5.0, 1.5]
    with pytest.raises(A.CallError):
        list(c.answer(iter(["bad"])))


class Echo:
    def answer(self, prompts):
        for p in prompts:
            yield json.dumps({"topic_type": "task", "body_xml": "<taskbody/>", "shortdesc": str(len(p)), "keywords": ["k"]})


def test_classify_with_and_without_annotator(spark):
    block = spark.read.parquet(f"{SMALL}/block.parquet")
    rules = A.classify(block)
    assert rules.where("body_xml is null").count() == 0 and rules.select("topic_type").distinct().count() == 3
    asked = A.classify(block, Echo())
    assert asked.count() == rules.count() and [r[0] for r in asked.select("topic_type").distinct().collect()] == ["task"]


def test_cached_prompts_are_not_asked(spark):
    prompts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "i int, prompt string")
    keyed = A.annotate(prompts, Echo()).cache()
    assert keyed.count() == 3
    cache = keyed.where("prompt = 'x'").select("key", F.lit("cached").alias("reply"))
    got = {r["i"]: r["reply"] for r in A.annotate(prompts, Echo(), cache=cache).collect()}
    assert got[1] == got[3] == "cached" and got[2] != "cached"


class LineDecoder:
    def pages(self, path, content):
        for i, part in enumerate(content.decode().split("\f")):
            yield (path, i + 1, part)


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.PDF").write_bytes(b"one\ftwo")
    (tmp_path / "in/sub/b.pdf").write_bytes(b"three")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    assert files.discover(spark, str(tmp_path / "in")).count() == 2
    assert files.decode(spark, str(tmp_path / "in"), LineDecoder(), "pages").count() == 3
    with pytest.raises(files.DecoderMissing):
        files.decode(spark, str(tmp_path / "in"), None)
    out = spark.createDataFrame([(1, 0, "x.dita", "<a/>"), (1, 1, "x.dita", "<b/>"), (2, 0, "../y.dita", None)], "doc_id bigint, topic_ix int, filename string, xml string")
    stored = {(r["doc_id"], r["name"]): r["value"] for r in sinks.write_texts(out, str(tmp_path / "out")).collect()}
    assert stored == {(1, "x.dita"): "<b/>", (2, "y.dita"): ""} and (tmp_path / "out/doc_id=1/name=x.dita").is_dir() and (tmp_path / "out/doc_id=2/name=y.dita").is_dir()
    images = spark.createDataFrame([(1, "a.PNG", b"1"), (1, "a.PNG", b"1"), (1, "b.gif", b"2"), (1, "c.jpg", b"3")], "doc_id bigint, name string, content binary")
    assert sinks.append_images(images, None, str(tmp_path / "images")).count() == 2
    assert sinks.append_images(images, spark.read.parquet(str(tmp_path / "images")), str(tmp_path / "images")).count() == 0
    results = spark.createDataFrame([("k", "r"), ("k", "r"), ("l", "s")], "key string, reply string")
    assert sinks.append_cache(results, None, str(tmp_path / "cache")).count() == 2
    again = sinks.append_cache(spark.createDataFrame([("k", "r"), ("m", "t")], "key string, reply string"), spark.createDataFrame([("k", "r"), ("l", "s")], "key string, reply string"), str(tmp_path / "cache"))
    assert [r["key"] for r in again.collect()] == ["m"] and spark.read.parquet(str(tmp_path / "cache")).count() == 3
    sinks.write_summary(spark.createDataFrame([("PASS", "x")], "a string, b string"), str(tmp_path / "tsv"))
    runs = spark.createDataFrame([("c", 3, 2, 1, 1.5), ("d", 1, 1, 0, 2.0)], "client_id string, stages int, done int, failed int, seconds double")
    report = {r["client"]: json.loads(r["json"]) for r in sinks.batch_report(runs).collect()}
    assert report[None] == {"total": 2, "passed": 1, "seconds": 3.5} and report["c"] == {"client": "c", "stages": 3, "done": 2, "failed": 1}
    sinks.write_batch_report(runs, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


class FlatCodec:
    """A picture is its width, a colon and filling; quality q leaves q per cent."""

    def width(self, content):
        return int(content.split(b":")[0])

    def narrow(self, content, width):
        return b"%d:" % width + content.split(b":")[1]

    def jpeg(self, content, quality):
        return content[: len(content) * quality // 100]


def test_images_are_capped(spark):
    data = [(1, "a.png", b"500:x"), (1, "b.PNG", b"1500:" + b"x" * 100), (1, "c.jpg", b"900:" + b"x" * 60), (1, "d.png", b"broken"), (1, "e.png", b"700:" + b"x" * 9000)]
    from strataloom.sources import images

    got = {r["name"]: (len(r["content"]), r["changed"]) for r in images.cap_images(spark.createDataFrame(data, "doc_id bigint, name string, content binary"), FlatCodec(), size=60).collect()}
    assert got == {"a.png": (5, False), "b.jpg": (57, True), "c.jpg": (54, True), "d.png": (6, False), "e.jpg": (4051, True)}
    with pytest.raises(files.DecoderMissing):
        images.cap_images(None, None)


def test_uploads_as_a_stream(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/One.PDF").write_bytes(b"1")
    (tmp_path / "up/two.txt").write_bytes(b"2")
    files.uploads(spark, str(tmp_path / "up")).writeStream.format("memory").queryName("ups").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("ups").collect()
    assert len(got) == 1 and re.fullmatch(r"[0-9a-f]{8}_One.PDF", got[0]["name"]) and bytes(got[0]["content"]) == b"1"


def test_settings_sample_and_recogniser(spark, tmp_path):
    env = {"A": "kept"}
    assert read_settings("# no\n\nA=new\nB = x=y \n=z\nplain\n  #C=1\nD=", env) == ["B", "D"] and env == {"A": "kept", "B": "x=y", "D": ""}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none/x.txt").write_bytes(b"")
        files.sample(spark, str(tmp_path / "none"))
    (tmp_path / "b.pdf").write_bytes(b"2")
    (tmp_path / "a.pdf").write_bytes(b"1")
    assert bytes(files.sample(spark, str(tmp_path)).first()["content"]) == b"1"

    class Fails:
        def read(self, content):
            return {b"ok": "# T"}[content]

    scans = spark.createDataFrame([(1, b"ok"), (2, b"bad"), (3, None)], "doc_id bigint, content binary")
    assert {r["doc_id"]: r["text"] for r in A.recognise(scans, Fails()).collect()} == {1: "# T", 2: None, 3: None}


def test_bundles(spark):
    rows = spark.createDataFrame([(1, 0, "b.dita", "<b/>"), (1, 1, "a.dita", None), (1, 1, "b.dita", "<new/>"), (1, 2, "c.dita", "é")], "doc_id bigint, topic_ix int, filename string, xml string")
    packed = sinks.bundles(rows, volume_topics=2)
    assert sorted(tuple(r) for r in sinks.unbundle(packed).collect()) == [(1, 0, "a.dita", ""), (1, 0, "b.dita", "<new/>"), (1, 1, "c.dita", "é")]
    assert {r["content"] for r in packed.collect()} == {r["content"] for r in sinks.bundles(rows, volume_topics=2).collect()}


def test_prompt_cache():
    now, made = [0.0], []
    cache = A.PromptCache(lambda model, system: made.append((model, system)) or (f"n{len(made)}" if system != "bad" else None), seconds=100, margin=10, clock=lambda: now[0])
    assert [cache.name("m", "s"), cache.name("m", "s"), cache.name("k", "s")] == ["n1", "n1", "n2"]
    now[0] = 95.0
    assert cache.name("m", "s") == "n3" and cache.name("m", "bad") is None and cache.name("m", "bad") is None and len(made) == 5


def test_repair_gives_up(spark):
    class Never:
        def answer(self, prompts):
            for p in prompts:
                assert p.startswith("Error: ")
                yield "<a>\x01</a>"

    t = spark.createDataFrame([(1, "<a/>"), (2, "<a>\x02"), (3, None)], "doc_id bigint, body_xml string")
    got = {r["doc_id"]: (r["valid"], r["tries"], r["error"] is None) for r in A.repair(t, Never()).collect()}
    assert got == {1: (True, 0, True), 2: (False, 2, False), 3: (True, 0, True)}


def _events(spark, rows):
    return spark.createDataFrame(rows, "client_id string, name string, status string, time double, detail string, ts string").withColumn("ts", F.to_timestamp("ts"))


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    _events(spark, [("a", "parse", "running", 1.0, None, "2024-01-01 00:00:00"), ("a", "parse", "done", 2.0, None, "2024-01-01 00:05:00"), ("b", "plan", None, None, None, "2024-01-01 00:01:00"), ("a", "parse", "done", 2.0, None, "2024-01-01 00:06:00")]).coalesce(1).write.parquet(str(folder))
    out = P.run_to_table(P.once_per_stage(P.read_events(spark, str(folder))).select("client_id", "name"))
    assert [tuple(r) for r in out.collect()] == [("a", "parse")]
    for name, stream in {"latest": P.latest_stages(P.read_events(spark, str(folder))), "snap": P.snapshots(P.read_events(spark, str(folder)))}.items():
        q = stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    latest = {(r["client_id"], r["name"]): r["status"] for r in spark.table("latest").collect()}
    assert latest == {("a", "parse"): "done", ("b", "plan"): None}
    snap = {r["client_id"]: (r["stages"], r["done"], r["active"], r["ended"]) for r in spark.table("snap").collect()}
    assert snap == {"a": (1, 1, None, True), "b": (1, 0, "plan", False)}
    windows = P.run_to_table(P.windowed_counts(P.read_events(spark, str(folder)), "1 minute", lateness="1 minute"))
    assert windows.where("n > 0").count() == windows.count()


def test_windows_run_to_the_end_of_the_data(spark, tmp_path):
    folder = tmp_path / "in"
    days = ["2024-01-20", "2024-01-19", "2024-01-01", "2024-01-20", "2024-01-02"]  # late rows in later files, the newest windows still open
    for i, day in enumerate(days):
        _events(spark, [("a", "parse", "done", 1.5, None, f"{day} 00:0{i}:00"), ("b", "plan", None, None, None, f"{day} 12:0{i}:00")]).coalesce(1).write.mode("append").parquet(str(folder))
    batch = spark.read.parquet(str(folder)).groupBy(F.window("ts", "10 minutes").alias("w"), "name").agg(F.count("*").alias("n"), F.sum("time").alias("seconds")).select("w.start", "w.end", "name", "n", "seconds")
    want = sorted(map(tuple, batch.collect()), key=repr)
    for files in (1, 8):  # the same rows however many files a trigger takes
        out = P.run_to_totals(P.windowed_counts(P.read_events(spark, str(folder), files), lateness="3 days"))
        assert out.columns == batch.columns and sorted(map(tuple, out.collect()), key=repr) == want
    folder.rename(tmp_path / "stage_event.parquet")
    assert sorted(map(tuple, core.queries()["t2_stream_windows"](spark, str(tmp_path)).collect()), key=repr) == want


def test_runs_are_forgotten_by_their_status():
    us = 1_000_000
    run = P.Run({}, 3600 * us, 5 * us)
    run.add("parse", "running", 0)
    run.add("parse", "done", 10 * us)
    assert run.kept_until() == 15 * us and not run.open()  # 5 s after the last stage was done
    run.add("plan", "running", 12 * us)
    assert set(run.stages) == {"parse", "plan"} and run.kept_until() == 3612 * us
    run.add("plan", "done", 20 * us)
    run.add("parse", "running", 26 * us)  # after the grace: a new run
    assert set(run.stages) == {"parse"}
    run.add("parse", "error", 27 * us)
    assert not run.stages and run.kept_until() is None  # at once
    kept = P.Run({}, None, 5 * us)
    kept.add("parse", "error", 0)
    assert kept.stages == {"parse": ("error", 0)} and kept.kept_until() is None


def test_snapshots_are_dropped_after_their_time(spark, tmp_path):
    folder = tmp_path / "in"
    for day, rows in enumerate([[("a", "parse", "done"), ("b", "parse", "running"), ("c", "parse", "error")], [("z", "parse", "running")], [("z", "plan", "running")]]):
        _events(spark, [(c, n, s, 1.0, None, f"2024-01-0{day + 1} 00:00:00") for c, n, s in rows]).coalesce(1).write.mode("append").parquet(str(folder))
    snaps = P.snapshots(P.read_events(spark, str(folder), 1), lateness="1 minute")
    clients = spark.createDataFrame([(c,) for c in "abczx"], "client_id string")
    got = {r["client_id"]: tuple(r)[1:] for r in P.poll(P.run_to_latest(snaps, "client_id"), clients).collect()}
    assert got == {"a": (0, 0, None, True), "b": (0, 0, None, True), "c": (0, 0, None, True), "x": (0, 0, None, True), "z": (1, 0, "plan", False)}


def test_event_stream_text(spark):
    part = lambda t: "data: " + json.dumps({"candidates": [{"content": {"parts": [{"text": t}]}}]})
    lines = [(1, 0, part("a")), (1, 1, ": ping"), (1, 2, "data: {bad"), (1, 3, part("b")), (1, 4, 'data: {"error": {"message": "full"}}'), (2, 0, "data: ")]
    got = {r["key"]: (r["text"], r["error"]) for r in P.event_stream_text(spark.createDataFrame(lines, "key int, n int, line string")).collect()}
    assert got == {1: ("ab", "full"), 2: ("", None)}


