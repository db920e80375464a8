"""Markdown, layout, sections and planning against sequential models and literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strataloom.operators import emit as E
from strataloom.operators import evaluation as V
from strataloom.operators import layout as L
from strataloom.operators import runs as R
from strataloom.operators import sections as S
from strataloom.plans.running import running_total
from strataloom.sources import markdown as M

BLOCK = "doc_id bigint, pos int, type string, text string, page int, level int"


def read_markdown(text):
    """A line-by-line model of the Markdown rules."""
    out, code, para, table = [], None, [], []

    def end():
        if para:
            out.append(("paragraph", " ".join(para), 0))
            para.clear()
        if table:
            out.append(("table", "\n".join(table), 0))
            table.clear()

    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            end()
            if code is None:
                code = []
            else:
                out.append(("code", "\n".join(code), 0))
                code = None
        elif code is not None:
            code.append(line)
        elif not s:
            end()
        elif m := re.match(r"(#{1,6})\s+(.+)$", s):
            end()
            out.append(("heading", m[2], len(m[1])))
        elif m := re.match(r"(?:[-*+]|\d+\.)\s+(.+)$", s):
            end()
            out.append(("list_item", m[1], 0))
        elif s.startswith("|") and (table or "|" in s[1:]):
            if not table:
                end()
            table.append(s)
        elif s[0] in "#-*+|":
            end()
            para.append(s)
        else:
            if table:
                end()
            para.append(s)
    end()
    return out


def test_markdown_against_a_line_loop(spark):
    rnd = random.Random(5)
    pool = ["text", "# Head", "#x", "- item", "-x", "1. one", "1.", "|a|b|", "|lone", "```", "", "  ", "more words", "* star", "####### seven", "|", "  |c|d|  ", "12. twelve"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(400)] + [(999, None)]
    got = {}
    for r in M.markdown_blocks(M.markdown_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))).orderBy("doc_id", "block_ix").collect():
        got.setdefault(r["doc_id"], []).append((r["type"], r["text"], r["level"]))
    for i, text in docs:
        assert got.get(i, []) == (read_markdown(text) if text is not None else []), text


@pytest.mark.parametrize("text,want", [
    ("```\nx", []), ("```\n```", [("code", "", 0)]), ("|a\nplain", [("paragraph", "|a plain", 0)]), ("|a|b|\n|c|d|", [("table", "|a|b|\n|c|d|", 0)]),
    ("|a|b|\n|c", [("table", "|a|b|\n|c", 0)]), ("text\n#x", [("paragraph", "text", 0), ("paragraph", "#x", 0)]), ("text\n1.", [("paragraph", "text 1.", 0)]),
])
def test_markdown_literals(spark, text, want):
    assert read_markdown(text) == want
    got = M.markdown_blocks(M.markdown_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).orderBy("block_ix").collect()
    assert [(r["type"], r["text"], r["level"]) for r in got] == want


def test_running_total_over_stretches(spark):
    rnd = random.Random(6)
    data = [(d, p, rnd.randint(0, 3)) for d in range(3) for p in sorted(rnd.sample(range(100), 40))]
    got = running_total(spark.createDataFrame(data, "doc_id bigint, pos int, v int"), "doc_id", "pos", F.col("v"), "t", stretch=7).collect()
    for d in range(3):
        total = 0
        for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["pos"]):
            total += r["v"]
            assert r["t"] == total


def merge(secs):
    """The greedy fold of concepts."""
    groups, i = [], 0
    while i < len(secs):
        j = i + 1
        if secs[i][0] == "concept":
            while j < len(secs) and secs[j][0] == "concept" and secs[j][1] >= secs[i][1]:
                j += 1
        groups.append(list(range(i, j)))
        i = j
    return groups


def test_topic_plan_against_the_fold(spark):
    rnd = random.Random(7)
    docs = {d: [(rnd.choice(["concept", "concept", "task", "reference"]), rnd.randint(1, 4)) for _ in range(rnd.randint(1, 10))] for d in range(300)}
    docs[999] = [("concept", 2), ("concept", 3), ("concept", 1), ("concept", 2)]
    typed = spark.createDataFrame([(d, i, f"t{i}", lv, t, 1) for d, secs in docs.items() for i, (t, lv) in enumerate(secs)], "doc_id bigint, section_ix int, title string, level int, topic_type string, n_blocks int")
    got = {}
    for r in S.topics(S.plan_topics(typed)).orderBy("doc_id", "topic_ix").collect():
        got.setdefault(r["doc_id"], []).append(r["section_indices"])
    assert got == {d: merge(s) for d, s in docs.items()}
    assert got[999] == [[0, 1], [2, 3]]


def test_sections(spark):
    b = spark.createDataFrame([
        (1, 0, "paragraph", "first", 1, 0), (1, 1, "heading", "Alert Settings", 1, 2), (1, 2, "paragraph", " alert SETTINGS ", 1, 0), (1, 3, "paragraph", "Page 3", 1, 0),
        (1, 4, "list_item", "Click and select", 1, 0), (1, 5, "heading", "Runs", 2, 1), (1, 6, "list_item", "Click, select", 2, 0), (1, 7, "paragraph", None, 2, 0), (1, 7, "paragraph", None, 2, 0), (2, 0, "table", "[]", 1, 0),
    ], BLOCK)
    placed = S.section_blocks(S.clean_blocks(S.distinct_blocks(b)))
    got = {(r["doc_id"], r["section_ix"]): (r["title"], r["level"], r["n_blocks"], r["topic_type"]) for r in S.topic_type(S.sections(placed)).collect()}
    assert got == {(1, 0): ("Introduction", 1, 1, "concept"), (1, 1): ("Alert Settings", 2, 1, "reference"), (1, 2): ("Runs", 1, 2, "task"), (2, 0): ("Introduction", 1, 1, "reference")}


def test_bodies(spark):
    rows = spark.createDataFrame([
        (1, 0, "task", 0, "paragraph", "before", 1, 0), (1, 0, "task", 1, "list_item", "1. a < b", 1, 0), (1, 0, "task", 2, "code", "x", 1, 0), (1, 0, "task", 3, "paragraph", "after", 1, 0), (1, 0, "task", 4, "list_item", "c", 1, 0),
        (1, 1, "reference", 5, "table", '[["h", "i"], ["a & b", null]]', 1, 0), (1, 1, "reference", 6, "table", "|x|y|\n|--|--|\n|1|2|", 1, 0), (1, 1, "reference", 7, "list_item", "dropped", 1, 0), (1, 1, "reference", 8, "table", "not a table", 1, 0),
        (1, 2, "concept", 9, "paragraph", "p", 1, 0), (1, 2, "concept", 10, "heading", "H", 1, 2), (1, 2, "concept", 11, "note", "n", 1, 0), (1, 2, "concept", 12, "heading", "I", 1, 3), (1, 2, "concept", 13, "list_item", "dropped", 1, 0),
    ], "doc_id bigint, topic_ix int, topic_type string, pos int, type string, text string, page int, level int")
    got = {r["topic_ix"]: r["body_xml"] for r in E.bodies(rows).collect()}
    assert got[0].count("<step ") == 2 and '<cmd class="- topic/ph task/cmd ">a &lt; b</cmd>\n<stepxmp' in got[0] and got[0].index("context") < got[0].index("<steps") < got[0].index("result")
    assert got[1].count("<table ") == 2 and "dropped" not in got[1] and 'cols="2"' in got[1] and "a &amp; b" in got[1] and got[1].count("<row ") == 4
    assert got[2].count("<section ") == 2 == got[2].count("</section>") and "dropped" not in got[2]


def test_links_images_and_clashes(spark):
    files = spark.createDataFrame([(1, "c_x.dita"), (1, "r_y.dita"), (1, "t_y.dita")], "doc_id bigint, filename string")
    links = spark.createDataFrame([(1, h) for h in ("r_x.dita", "c_x.dita", "http://a/r_x.dita", "a/r_x.dita", "c_y.dita", "c_z.dita")], "doc_id bigint, href string")
    got = {r["href"]: r["target"] for r in E.resolve_links(links, files).collect()}
    assert got == {"r_x.dita": "c_x.dita", "c_x.dita": "c_x.dita", "http://a/r_x.dita": "http://a/r_x.dita", "a/r_x.dita": "a/r_x.dita", "c_y.dita": "r_y.dita", "c_z.dita": "c_z.dita"}
    stored = spark.createDataFrame([(1, "i.png"), (1, "i.jpg"), (1, "j.gif")], "doc_id bigint, filename string")
    refs = spark.createDataFrame([(1, "i.gif"), (1, "j.gif"), (1, "k.png")], "doc_id bigint, href string")
    assert {r["href"]: r["target"] for r in E.resolve_images(refs, stored).collect()} == {"i.gif": "i.jpg", "j.gif": "j.gif", "k.png": "k.png"}
    text = '<a><xref class="k" href="r_x.dita">q</xref><xref href="http://h/r_x.dita"/><xref href="c_x.dita"/><xref href="c_y.dita"/><image href="i.gif" class="z"/><image class="k" href="j.gif"/><p href="r_x.dita"/></a>'
    f = spark.createDataFrame([(1, 0, "c_x.dita", text), (1, 1, "r_y.dita", "<a/>"), (1, 2, "t_z.dita", None), (2, 0, "r_x.dita", '<xref href="r_x.dita"/>')], "doc_id bigint, topic_ix int, filename string, xml string")
    got = {(r["doc_id"], r["topic_ix"]): r["xml"] for r in E.write_references(f, stored).collect()}
    assert got[1, 0] == text.replace('"k" href="r_x', '"k" href="c_x').replace('href="c_y', 'href="r_y').replace("i.gif", "i.jpg") and got[1, 1] == "<a/>" and got[1, 2] is None and got[2, 0] == '<xref href="r_x.dita"/>'
    topic = spark.createDataFrame([(1, 0, "A", "task", "<taskbody/>", "s", ["K"]), (1, 1, "A", "task", None, None, None), (1, 2, None, None, "<conbody/>", " ", [])], "doc_id bigint, topic_ix int, title string, topic_type string, body_xml string, shortdesc string, keywords array<string>")
    f = {r["topic_ix"]: r for r in E.topic_files(topic).collect()}
    assert f[0]["clash"] and f[1]["clash"] and not f[2]["clash"] and f[0]["filename"] == "t_a.dita" and "<keyword " in f[0]["xml"] and "<shortdesc" not in f[2]["xml"]


def test_metrics(spark):
    e = spark.createDataFrame([(1, "<a><p/><p/><q/></a>")], "doc_id bigint, x string")
    a = spark.createDataFrame([(1, '<a class="z"><p class="+ topic/ph ui-d/uicontrol "/><r/></a>')], "doc_id bigint, x string")
    en, an = V.element_rows(e, ["doc_id"], "x"), V.element_rows(a, ["doc_id"], "x")
    r = V.structural_f1(en, an, ["doc_id"]).first()
    assert (r["common"], r["expected"], r["actual"]) == (2, 4, 3) and r["f1"] == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5))
    c = {(r["doc_id"]): r["coverage"] for r in V.class_coverage(an, ["doc_id"]).collect()}
    assert c == {1: pytest.approx(2 / 3), None: pytest.approx(2 / 3)}
    assert {r["tag"]: r["n"] for r in V.element_counts(an, ["doc_id"]).collect()} == {"a": 1, "p": 1, "r": 1, "ui-d:uicontrol": 1}
    line = spark.range(1).select(V.report_line(F.lit("m"), F.lit(0.75))).first()[0]
    assert line == "~ m " + "#" * 15 + "." * 5 + " 75.0%"


def test_layout(spark):
    def word(i, text, top, size=10.0, font="Serif", x=None, page=1):
        return (1, page, i, text, float(x if x is not None else i * 10), float(i * 10 + 8), float(top), float(top) + size, font, float(size))

    words = [
        word(0, "Running", 40, 10), word(1, "Title", 60, 18, "Serif-Bold"), word(2, "one", 80), word(3, "two", 80), word(4, "three", 92), word(5, "far", 120),
        word(6, "code", 132, 9, "Courier"), word(7, "more", 144, 9, "Courier"), word(8, "Note:", 156, 10, "Serif-Bold"), word(9, "goes", 190), word(10, "1.", 202), word(11, "item", 202), word(12, "tiny", 214, 8), word(13, "Page", 226), word(14, "1", 226),
    ]
    w = spark.createDataFrame(words, "doc_id bigint, page int, word_ix int, text string, x0 double, x1 double, top double, bottom double, fontname string, size double")
    boxes = spark.createDataFrame([], "doc_id bigint, page int, x0 double, top double, x1 double, bottom double")
    pages = spark.createDataFrame([(1, 1, "Running Title one two three and many more words so that it is no scanned page, really, not at all, no no")], "doc_id bigint, page int, text string")
    got = [(r["type"], r["text"], r["level"]) for r in L.layout_blocks(w, boxes, pages).orderBy("block_ix").collect()]
    assert got == [("heading", "Title", 1), ("paragraph", "one two three", 0), ("paragraph", "far", 0), ("code", "code\nmore", 0), ("note", "Note: goes", 0), ("list_item", "1. item", 0)]
    assert L.scanned_documents(pages).count() == 0 and L.cover_pages(w.withColumn("size", F.lit(31.0))).count() == 1
    box = spark.createDataFrame([(1, 1, 0.0, 79.0, 999.0, 103.0)], boxes.schema)
    assert {r["text"] for r in L.words_outside_tables(w, box).collect()} == {x[3] for x in words} - {"one", "two", "three"}


def test_tables_go_before_the_next_heading(spark):
    b = spark.createDataFrame([(1, 0, "heading", "a", 1, 100.0), (1, 1, "paragraph", "b", 1, None), (1, 2, "heading", "c", 1, 300.0), (1, 3, "paragraph", "d", 1, None)], "doc_id bigint, pos int, type string, text string, page int, y_pos double")
    t = spark.createDataFrame([(1, 1, 0, 200.0, "T1"), (1, 1, 1, 400.0, "T2"), (2, 1, 0, 0.0, "T3")], "doc_id bigint, page int, table_ix int, top double, text string")
    got = [r["text"] for r in L.insert_tables(b, t).orderBy("doc_id", "pos", "part").collect()]
    assert got == ["a", "b", "T1", "c", "d", "T2", "T3"]


def test_runs(spark):
    ev = spark.createDataFrame([("a", "parse", "running", 1.0, "2024-01-01 00:00:00"), ("a", "parse", "done", 2.0, "2024-01-01 00:00:00"), ("a", "plan", None, None, "2024-01-01 00:00:05"), ("b", "parse", "error", 1.0, "2024-01-01 00:00:00"), ("b", "odd", "done", 1.0, "2024-01-01 00:00:00")], "client_id string, name string, status string, time double, ts string").withColumn("ts", F.to_timestamp("ts"))
    latest = R.latest_stages(ev)
    assert {(r["client_id"], r["name"]): r["status"] for r in latest.collect()} == {("a", "parse"): "running", ("a", "plan"): None, ("b", "parse"): "error", ("b", "odd"): "done"}
    assert {r["client_id"]: r["active"] for r in R.active_stage(latest).collect()} == {"a": "parse", "b": None}
    assert R.stage_view(latest).count() == 3
    assert {r["client_id"]: (r["stages"], r["failed"]) for r in R.run_summary(ev).collect()} == {"a": (3, 0), "b": (2, 1)}
    assert R.image_cap_audit(spark.createDataFrame([(1, 900, 10), (1, 2000, 10), (1, None, 1)], "doc_id bigint, width int, bytes bigint")).first()[1:] == (1, 1)


TOPIC = "doc_id bigint, topic_ix int, document string, title string, product string, filename string"


def told(topic, topics):
    """The prompt of a topic with one paragraph, as the statement has it."""
    _, _, document, title, product, _ = topic
    out = "".join(f"{n}: {v}\n" for n, v in (("Document", document), ("Topic", title), ("Product", product)) if v)
    others = [t for t in topics if None not in (t[3], title) and t[3] != title]
    files = [f"  {t[3]} = {t[5]}\n" for t in others if t[5]]
    out += f"Other topics: {', '.join(t[3] for t in others)}\n" if others else ""
    return out + ("Files of other topics:\n" + "".join(files) if files else "") + f"\nBlocks:\n[PARAGRAPH] text {topic[1]}\n"


def prompted(spark, heads):
    rows = [(h[0], h[1], "paragraph", h[1], f"text {h[1]}", 1) for h in heads]
    return S.prompts(spark.createDataFrame(rows, "doc_id bigint, topic_ix int, type string, pos int, text string, level int"), spark.createDataFrame(heads, TOPIC))


def test_prompts_name_the_other_topics(spark):
    rng = random.Random(4)
    docs = [[""], [""] * 2, ["", "A"], ["A"] * 5, ["A", "A", "B"], ["A", "B", "B"], [None, "A"], [None] * 2, ["A", None, "A", "B"], ["A", "B"] * 3]
    docs += [[rng.choice(["Größe", "日本", "A, B", "A", "", None, " = ", "𝒜"]) for _ in range(rng.choice([3, 7, 450]))] for _ in range(9)]
    heads = [[(d, i * (1 + d % 2 * 90), f"doc {d}" if d % 3 else None, t, "P" if d % 2 else None, None if d % 5 == 1 and i % 2 else f"c_{i}.dita" if d % 4 else "") for i, t in enumerate(ts)] for d, ts in enumerate(docs)]
    got = {(r["doc_id"], r["topic_ix"]): r["prompt"] for r in prompted(spark, [h for d in heads for h in d]).collect()}
    assert got == {h[:2]: told(h, d) for d in heads for h in d}


def test_prompts_of_a_huge_document_are_not_moved(spark):
    """What other topics are called is 24 MB in the prompts; what is shuffled must not be of that kind."""
    heads = [(7, i, "Manual", f"Title of the topic with number {i:04d}", None, f"c_title_of_the_topic_with_number_{i:04d}.dita") for i in range(450)]
    ran = prompted(spark, heads)._jdf.queryExecution()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ran.toRdd().count() == 450
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def moved(p):
        kind = p.getClass().getSimpleName()
        own = p.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
        below = [p.finalPhysicalPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind == "ShuffleQueryStageExec" else [p.children().apply(i) for i in range(p.children().size())]
        return own + sum(map(moved, below))

    assert 0 < moved(ran.executedPlan()) < 2_000_000
