"""Literal cases of the scalar functions."""

import re
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import xmltree as X
from strataloom.sources.files import log_results, salvage_plan, salvage_reply

CASES = [
    (T.rejoin_hyphens, "cost ‑ to ‑ market", "cost-to-market"),
    (T.rejoin_hyphens, "a - b - c", "a-b-c"),
    (T.rejoin_hyphens, " x -y ", "x -y"),
    (T.strip_number, "3.  Set up", "Set up"),
    (T.slug, "Set Up: 2a-7  Processing!", "set_up_2a_7_processing"),
    (T.slug, "--é--", ""),
    (T.map_filename, "My Map", "m_my_map.ditamap"),
    (T.xml_escape, '<a & "b">', "&lt;a &amp; &quot;b&quot;&gt;"),
    (T.html_escape, '<a & "b">', '&lt;a &amp; "b"&gt;'),
    (T.strip_invisible, "a​b&#x200B;c", "abc"),
    (T.drop_etc, "x, etc. The y, etc.", "x. The y."),
    (T.drop_etc, "<p>a, etc.</p>", "<p>a.</p>"),
    (T.strip_preamble, '<b><p class="p">This section describes the x. Then y.</p><p>This topic covers z. Q.</p></b>', '<b><p class="p">Then y.</p><p>This topic covers z. Q.</p></b>'),
    (T.unescape_quotes, 'class=\\"x\\"', 'class="x"'),
    (T.close_class_attribute, '<p class="x" "text</p>', '<p class="x">text</p>'),
    (T.escape_tags_in_attributes, '<a href="see <topic> or <x />">', '<a href="see &lt;topic> or &lt;x />">'),
    (T.escape_tags_in_attributes, '<p>x <b> "q" <c></p><a href="' + "<t> < " * 30 + '" b="<i/>" c="y">', '<p>x <b> "q" <c></p><a href="' + "&lt;t> < " * 30 + '" b="&lt;i/>" c="y">'),
    (T.escape_tags_in_attributes, '<b> x="' + "<b>" * 9, '<b> x="' + "&lt;b>" * 9),
    (T.collapse_double_close, "<entry>a</entry> </entry></row>\n</row>", "<entry>a</entry></row>"),
    (T.fill_table_groups, "<tgroup><thead/></tgroup><tgroup><tbody/></tgroup>x", "<tgroup><thead/>" + T.EMPTY_TBODY + "</tgroup><tgroup><tbody/></tgroup>x"),
    (T.strip_doctype, '<!DOCTYPE a SYSTEM "x"><a/>', "<a/>"),
    (T.markup_text, "<a> x <b>y</b>\n z</a>", "x y z"),
    (T.product_name, "Use ABC's tools and XYZ's", "ABC"),
    (T.strip_fences, "```json\n{}\n```", "{}"),
    (T.title_from_filename, "c_set_up_x.dita", "Set Up X"),
    (T.title_case, "it's 2a-b", "It'S 2A-B"),
    (T.provider_of, "Claude-x", "claude"),
    (T.inner_path, "a/./b//../c.html", "a/c.html"),
    (T.inner_path, "a/../../a/c.html", None),
    (T.inner_path, "/etc/passwd", None),
]


@pytest.mark.parametrize("function,given_,want", CASES)
def test_literal(spark, function, given_, want):
    df = spark.createDataFrame([(given_,), (None,)], "x string")
    got = [r[0] for r in df.select(function(F.col("x"))).collect()]
    assert got[0] == want and (got[1] is None or function in (T.provider_of, T.product_name))


def test_more_literals(spark):
    df = spark.createDataFrame([(1,)], "i int")
    one = lambda c: df.select(c).first()[0]
    assert one(T.cache_key(F.lit("p"), F.lit("u"))) == "8161d151a724e3f0"
    assert one(T.topic_filename(F.lit("A b"), F.lit("task"))) == "t_a_b.dita" and one(T.topic_filename(F.lit("A b"), F.lit(None).cast("string"))) == "c_a_b.dita"
    assert sorted(one(T.word_set(F.lit("Été à été x_1 naïve")))) == ["naïve", "x_1", "à", "été"]
    assert one(T.normal_keywords(F.array(*map(F.lit, [" A ", "", "b" * 50, "c", "d", "e", "f", "g", "h"])))) == ["a", "b" * 40, "c", "d", "e", "f", "g"]
    assert [one(T.human_size(F.lit(n))) for n in (5, 2048, 3_145_728)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert one(T.f1(F.lit(0.0), F.lit(0.0))) == 0.0 and one(T.f1(F.lit(1.0), F.lit(0.5))) == pytest.approx(2 / 3)
    assert one(T.retry_delay(F.lit(2.0), F.lit(None).cast("double"), F.lit(False))) == 2.25 and one(T.retry_delay(F.lit(0.0), F.lit(60.0), F.lit(True))) == 20 and one(T.retry_delay(F.lit(0.0), F.lit(None).cast("double"), F.lit(True))) == 5
    assert one(T.retry_hint(F.lit("please Retry in 9.4s."))) == 9.4 and one(T.retry_hint(F.lit("no"))) is None
    assert one(T.document_title(F.lit("abc"), F.lit("/x/my_file-name.pdf"))) == "My File Name" and one(T.document_title(F.lit(" Title "), F.lit("x"))) == "Title"
    assert one(T.is_footer(F.lit("see page 4"), F.lit(4))) and one(T.is_footer(F.lit("Page  3 of"), F.lit(9))) and not one(T.is_footer(F.lit("see page 4"), F.lit(5)))
    assert one(T.is_monospace(F.lit("FiraCode-Regular"))) and one(T.is_bold(F.lit("XBold"))) and not one(T.is_bold(F.lit(None).cast("string")))
    assert one(T.validator_passed(F.lit("fine"), F.lit(0))) and not one(T.validator_passed(F.lit("[DOTJ013E] x"), F.lit(0))) and not one(T.validator_passed(F.lit("ok"), F.lit(1)))


@given(st.lists(st.text(st.sampled_from("ab -‑"), max_size=12), min_size=1, max_size=20))
@settings(max_examples=20, deadline=None)
def test_hyphens_reach_the_fixpoint(spark, texts):
    def loop(s):
        s, last = s.strip(), None
        while s != last:
            last, s = s, re.sub(r"(\w)\s+[‑-]\s+(\w)", r"\1-\2", s)
        return s

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.rejoin_hyphens(F.col("x"))).collect()
    assert {i: v for i, v in got} == {i: loop(t) for i, t in enumerate(texts)}


def test_salvage(spark):
    replies = ['{"topic_type": "task", "body_xml": "<taskbody/>"}', 'Here:\n```json\n{"topic_type": "task", "body_xml": "b"}\n```', '{"topic_type": "reference", "keywords": ["a"], "body_xml": "<refbody class="x">y</refbody>"', "nonsense", None, ""]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", salvage_reply(F.col("r"), F.lit("T")).alias("x")).orderBy("i").collect()
    assert [r.x.topic_type for r in got] == ["task", "task", "reference", "concept", "concept", "concept"]
    assert got[2].x.body_xml == '<refbody class="x">y</refbody>' and got[2].x.keywords == ["a"] and got[3].x.shortdesc == "T"
    plans = spark.createDataFrame([('say [{"topic_title": "a", "section_indices": [0, 1]}] ok',), ("no",)], "r string").select(salvage_plan(F.col("r")).alias("p")).collect()
    assert plans[0].p[0].section_indices == [0, 1] and plans[1].p is None


def test_logs(spark):
    got = log_results(spark.createDataFrame([("a\n  VALIDATION:  PASS\n  ✗ one\n  ✗ two",), ("x",)], "text string")).collect()
    assert [(r.result, r.errors) for r in got] == [("PASS", 2), ("?", 0)]


# -- trees

TREES = [
    ("<conbody><section><p>s</p></section><p>a</p></conbody>", "<conbody><p>a</p><section><p>s</p></section></conbody>"),
    ("<conbody>bare <b>x</b> tail</conbody>", '<conbody><p class="- topic/p ">bare <b>x</b> tail</p></conbody>'),
    ("<conbody>bare<p>x</p>tail</conbody>", '<conbody><p class="- topic/p ">bare</p><p>x</p><p class="- topic/p ">tail</p></conbody>'),
    ("<refbody><p>a</p><section><p>b</p></section></refbody>", '<refbody><section class="- topic/section "><p>a</p></section><section><p>b</p></section></refbody>'),
    ("<taskbody><p>pre</p><steps><step><cmd>c</cmd><codeblock>k</codeblock></step></steps><p>post</p></taskbody>",
     '<taskbody><context class="- topic/section task/context "><p>pre</p></context><steps><step><cmd>c</cmd><info class="- topic/itemgroup task/info "><codeblock>k</codeblock></info></step></steps><result class="- topic/section task/result "><p>post</p></result></taskbody>'),
    ("<steps><step>do it</step></steps>", '<steps><step><cmd class="- topic/ph task/cmd ">do it</cmd></step></steps>'),
    ("<steps><step><info><p>x</p></info></step></steps>", '<steps><step><cmd class="- topic/ph task/cmd ">Complete this step.</cmd><info><p>x</p></info></step></steps>'),
    ("<conbody><section><section><p>n</p></section><p>m</p></section></conbody>", "<conbody><section><p>m</p></section><section><p>n</p></section></conbody>"),
    ("<conbody><p>fine</p></conbody>", "<conbody><p>fine</p></conbody>"),
    ("<conbody><p>cut", "<conbody><p>cut</p></conbody>"),
    ("<conbody><p>a & b</p></li></conbody>", "<conbody><p>a &amp; b</p></conbody>"),
    ("", ""),
]


@pytest.mark.parametrize("body,want", TREES)
def test_content_model(body, want):
    got = X.fix_body(body)
    assert got == want and X.is_well_formed(f"<r>{got}</r>") and X.fix_body(got) == got


def test_tree_columns(spark):
    df = spark.createDataFrame([("<a><b/></a>",), ("<a>",), (None,)], "x string")
    assert [r[0] for r in df.select(X.well_formed(F.col("x"))).collect()] == [True, False, None]


def test_pretty():
    assert X.pretty("<a><b>x<c/><d/></b><e><f/></e></a>") == "<a>\n  <b>x<c/><d/></b>\n  <e>\n    <f/>\n  </e>\n</a>"
    assert X.pretty("<a><b>") == "<a><b>" and X.pretty(None) is None and X.pretty(X.pretty("<a> <b/>\n</a>")) == "<a>\n  <b/>\n</a>"


@given(st.lists(st.text("ab -\tc", max_size=200), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None)
def test_wrapped_lines(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "x" * 200 + " y")], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", T.wrap(F.col("t")).alias("w")).collect()}
    assert got[99] is None and got[98] == "x" * 200 + "\ny"
    for i, t in enumerate(texts):
        assert got[i] == t if len(t) <= 80 else got[i].replace("\n", "").replace(" ", "") == "".join(t.split())
        assert len(t) <= 80 or all(len(line) <= 80 or " " not in line for line in got[i].split("\n"))


def test_wrapping_as_the_standard_library_fills(spark):
    text = "The year-end run compares any cut-off time " * 9
    want = textwrap.fill(text, 80, break_long_words=False, replace_whitespace=False)
    assert spark.createDataFrame([(text,)], "t string").select(T.wrap(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("path", "name"), [("a/b/../x.pdf", "x.pdf"), ("..\\evil.pdf", "evil.pdf"), (None, "upload.pdf"), ("..", "upload.pdf"), ("dir/", "dir"), ("", "upload.pdf")])
def test_safe_names(spark, path, name):
    got = spark.createDataFrame([(path,)], "p string").select(T.safe_upload_name(F.col("p"), F.lit("7"))).first()[0]
    assert re.fullmatch(r"[0-9a-f]{8}_" + re.escape(name), got)
