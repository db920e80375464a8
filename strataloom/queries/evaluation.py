"""Queries of the evaluation metrics: topics as element tables, pairs of topics compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import evaluation as V
from strataloom.operators import xmltree as X
from strataloom.plans.tables import table
from strataloom.queries.registry import WD, esc_sql, query, strip_sql
from strataloom.queries.topics import _FILES, _MAPS, b2_maps, files

KEYS = ["doc_id", "topic_ix"]

_TOPICS = "ft as (select doc_id, topic_ix, min(body_xml) as xml from topic where body_xml is not null group by all)"
_NODES = r"""nt as (select doc_id, topic_ix, unnest(range(len(t))) as node_ix, unnest(t) as t from (select doc_id, topic_ix, regexp_extract_all(regexp_replace(regexp_replace(xml, '<!DOCTYPE[^>]+>', '', 'g'), '(?s)<\?.*?\?>|<!--.*?-->|<!\[CDATA\[.*?\]\]>', '', 'g'), '<(/?[A-Za-z_][^<>]*)>', 1) as t from ft)),
nd as (select doc_id, topic_ix, node_ix, regexp_extract(t, '^/?([A-Za-z_][A-Za-z0-9_.:-]*)', 1) as tag, nullif(regexp_extract(t, '\bclass="([^"]*)"', 1), '') as class, starts_with(t, '/') as closes, ends_with(t, '/') as empty from nt)"""
_DEPTHS = "dp as (select * from (select *, greatest(coalesce(sum(case when closes then -1 when empty then 0 else 1 end) over (partition by doc_id, topic_ix order by node_ix rows between unbounded preceding and 1 preceding), 0), 0)::bigint as depth from nd) where not closes)"
_COUNTS = "ec as (select doc_id, topic_ix, tag, count(*) as n from (select doc_id, topic_ix, tag from nd where not closes " + " ".join(
    f"union all select doc_id, topic_ix, '{d}:' || regexp_extract(class, '{d}/([A-Za-z0-9_]+)', 1) from nd where not closes and regexp_extract(class, '{d}/([A-Za-z0-9_]+)', 1) <> ''" for d in V.DOMAINS
) + ") group by all)"


def topic_markup(spark: SparkSession, sf: str) -> DataFrame:
    """One body per topic key (the smallest, should copies differ)."""
    return table(spark, sf, "topic").where("body_xml is not null").groupBy(*KEYS).agg(F.min("body_xml").alias("xml"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return V.element_rows(topic_markup(spark, sf), KEYS, "xml")


def next_of(df: DataFrame) -> DataFrame:
    """Rows of topic n + 1 under the key of topic n."""
    return df.withColumn("topic_ix", F.col("topic_ix") - 1)


@query("w14_depths", f"with {_TOPICS}, {_NODES}, {_DEPTHS} select doc_id, topic_ix, depth, tag, count(*) as n from dp group by all")
def w14_depths(spark, sf):
    """Tree signatures as (depth, tag) counts."""
    return V.depths(nodes(spark, sf), KEYS).groupBy(*KEYS, F.col("depth").cast("bigint").alias("depth"), "tag").agg(F.count("*").alias("n"))


@query("g8_element_counts", f"with {_TOPICS}, {_NODES}, {_COUNTS} select * from ec")
def g8_element_counts(spark, sf):
    return V.element_counts(nodes(spark, sf), KEYS)


@query("g9_class_coverage", f"with {_TOPICS}, {_NODES} select doc_id, topic_ix, count(*) as total, count(class) as with_class, round(count(class) / count(*), 9) as coverage from nd where not closes group by grouping sets ((doc_id, topic_ix), ())")
def g9_class_coverage(spark, sf):
    return V.class_coverage(nodes(spark, sf), KEYS).withColumn("coverage", F.round("coverage", 9))


@query("g11_topic_accuracy", "with t as (select doc_id, topic_ix, min(regexp_extract(body_xml, '^\\s*<([a-z]+)body', 1)) as tag from topic where body_xml is not null group by all), o as (select distinct doc_id, topic_ix, filename from out_file), j as (select case when filename like 't\\_%' escape '\\' then 'task' when filename like 'r\\_%' escape '\\' then 'ref' else 'con' end = tag as ok from o join t using (doc_id, topic_ix)) select count(*) as total, count(*) filter (ok) as correct, round(count(*) filter (ok) / greatest(count(*), 1), 9) as accuracy from j")
def g11_topic_accuracy(spark, sf):
    """Type by file name against the type of the body."""
    t = topic_markup(spark, sf).select(*KEYS, F.regexp_extract("xml", r"^\s*<([a-z]+)body", 1).alias("tag"))
    o = table(spark, sf, "out_file").select(*KEYS, "filename").distinct()
    kind = F.when(F.startswith("filename", F.lit("t_")), "task").when(F.startswith("filename", F.lit("r_")), "ref").otherwise("con")
    return o.join(t, KEYS).agg(F.count("*").alias("total"), F.count_if(kind == F.col("tag")).alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.greatest("total", F.lit(1)), 9))


_PAIRS = "pr as (select e.doc_id, e.topic_ix from ft e join ft a on a.doc_id = e.doc_id and a.topic_ix = e.topic_ix + 1)"


@query(
    "g12_structural_f1",
    f"""with {_TOPICS}, {_NODES}, {_DEPTHS}, {_PAIRS}, s as (select doc_id, topic_ix, depth, tag, count(*) as n from dp group by all),
e as (select s.* from s join pr using (doc_id, topic_ix)), a as (select s.doc_id, s.topic_ix - 1 as topic_ix, depth, tag, n from s where (s.doc_id, s.topic_ix - 1) in (select doc_id, topic_ix from pr)),
j as (select doc_id, topic_ix, coalesce(e.n, 0) as e, coalesce(a.n, 0) as a from e full join a using (doc_id, topic_ix, depth, tag)),
g as (select doc_id, topic_ix, sum(least(e, a))::bigint as common, sum(e)::bigint as expected, sum(a)::bigint as actual from j group by all)
select *, round(case when common = 0 then 0 else 2 * (common / greatest(actual, 1)) * (common / greatest(expected, 1)) / (common / greatest(actual, 1) + common / greatest(expected, 1)) end, 9) as f1 from g""",
)
def g12_structural_f1(spark, sf):
    """Each topic against the next one of its document."""
    t = topic_markup(spark, sf)
    pairs = t.select(*KEYS).join(next_of(t).select(*KEYS), KEYS)
    n = nodes(spark, sf)
    e, a = n.join(pairs, KEYS, "left_semi"), next_of(n).join(pairs, KEYS, "left_semi")
    g = V.structural_f1(e, a, KEYS)
    return g.select(*KEYS, *(F.col(c).cast("bigint").alias(c) for c in ("common", "expected", "actual")), F.round("f1", 9).alias("f1"))


#: Elements that the bodies have none of, put behind them by the last digit of topic_ix: the first two in topics of both kinds, the others in one only.
_PLANTS = {
    "0": '<menucascade class="+ topic/ph ui-d/menucascade "/>', "1": '<menucascade class="+ topic/ph ui-d/menucascade "/><codeblock class="+ topic/pre pr-d/codeblock "/>',
    "2": '<wintitle class="+ topic/keyword ui-d/wintitle "/><codeblock class="+ topic/pre pr-d/codeblock "/>', "3": '<option class="+ topic/keyword pr-d/option "/>',
}
_PLANTED = "ft as (select doc_id, topic_ix, min(body_xml) || (case topic_ix % 4 " + " ".join(f"when {k} then '{v}'" for k, v in _PLANTS.items()) + " end) as xml from topic where body_xml is not null group by doc_id, topic_ix)"


@query(
    "g13_semantic_coverage",
    f"""with {_PLANTED}, {_NODES}, {_COUNTS}, e as (select tag, sum(n) as n from ec where topic_ix % 2 = 0 group by tag), a as (select tag, sum(n) as n from ec where topic_ix % 2 = 1 group by tag),
x as (select e.tag, a.n is not null as hit from e left join a using (tag) where e.tag in ('"""
    + "', '".join(V.SEMANTIC) + "')) select count(*) filter (hit) as matched, count(*) as total, round(count(*) filter (hit) / greatest(count(*), 1), 9) as score from x",
)
def g13_semantic_coverage(spark, sf):
    """Elements of even topics taken as expected, of odd ones as actual; elements of all kinds are put into the bodies."""
    plant = F.lit("")
    for k, v in _PLANTS.items():
        plant = F.when(F.col("topic_ix") % 4 == int(k), v).otherwise(plant)
    c = V.element_counts(V.element_rows(topic_markup(spark, sf).withColumn("xml", F.concat("xml", plant)), KEYS, "xml"), KEYS)
    return V.semantic_coverage(c.where("topic_ix % 2 = 0"), c.where("topic_ix % 2 = 1")).withColumn("score", F.round("score", 9))


_TEXT = rf"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(xml, '<!DOCTYPE[^>]+>', '', 'g'), '(?s)<\?.*?\?>|<!--.*?-->', '', 'g'), '<[^>]*>'), lambda x: {strip_sql('x')}), lambda x: x <> ''), ' ')"
_WORDS = f"list_distinct(regexp_extract_all(lower({_TEXT}), '[{WD}]+'))"


@query(
    "g14_word_f1",
    f"with {_TOPICS}, w as (select doc_id, topic_ix, {_WORDS} as w from ft), j as (select e.doc_id, e.topic_ix, len(list_intersect(e.w, a.w)) as c, len(e.w) as ne, len(a.w) as na from w e join w a on a.doc_id = e.doc_id and a.topic_ix = e.topic_ix + 1) "
    "select doc_id, topic_ix, round(c / greatest(na, 1), 9) as precision, round(c / greatest(ne, 1), 9) as recall, round(case when c = 0 then 0 else 2 * (c / greatest(na, 1)) * (c / greatest(ne, 1)) / (c / greatest(na, 1) + c / greatest(ne, 1)) end, 9) as f1 from j",
)
def g14_word_f1(spark, sf):
    """G14, F18, F20, U2."""
    t = topic_markup(spark, sf)
    j = t.join(next_of(t).withColumnRenamed("xml", "other"), KEYS)
    return j.select(*KEYS, *(F.round(c, 9).alias(n) for n, c in V.word_f1(F.col("xml"), F.col("other")).items()))


#: What is expected of the maps: a reference per planned topic, in every seventh document one more; keys where doc_id is a multiple of 3 or of 4.
_EXPECTED_MAPS = """em as (select doc_id, case when doc_id % 3 = 0 or doc_id % 4 = 0 then ['product-name'] else []::varchar[] end as keys, count(distinct topic_ix) + (doc_id % 7 = 0)::int as refs from topic_plan group by doc_id),
am as (select doc_id, len(regexp_extract_all(xml, '<topicref\\b')) as refs, list_sort(list_distinct(regexp_extract_all(xml, '<keydef\\b[^>]*?\\bkeys="([^"]*)"', 1))) as keys, contains(xml, '<title') as titled from maps),
mm as (select doc_id, em.refs = am.refs as refs_equal, em.keys = am.keys as keys_equal, titled as has_title, ((em.refs = am.refs)::int + (em.keys = am.keys)::int + titled::int) / 3.0 as score from em join am using (doc_id))"""


def expected_maps(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "topic_plan").groupBy("doc_id").agg(F.countDistinct("topic_ix").alias("n"))
    n = (F.col("n") + (F.col("doc_id") % 7 == 0).cast("int")).cast("int")
    keys = F.when((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 4 == 0), '<keydef class="x" keys="product-name"/>').otherwise("")
    return p.select("doc_id", F.concat(F.lit("<map><title/>"), F.repeat(F.lit('<topicref href="x"/>'), n), keys, F.lit("</map>")).alias("xml"))


@query("g15_map_score", f"with {_MAPS}, {_EXPECTED_MAPS} select doc_id, refs_equal, keys_equal, has_title, round(score, 9) as score from mm")
def g15_map_score(spark, sf):
    """Emitted maps against the plans, by number of references, set of keys and title."""
    return V.map_metrics(expected_maps(spark, sf), b2_maps(spark, sf), ["doc_id"]).withColumn("score", F.round("score", 9))


# Pairs of files made so that SQL knows which of them are well-formed: every seventh lacks the end tag of its root.
_T, _S = esc_sql("coalesce(title, '')"), esc_sql("coalesce(shortdesc, '')")
_PAIRED = f"""fr as (select doc_id, topic_ix, min(coalesce(title, '')) as title, min(coalesce(shortdesc, '')) as shortdesc, min(coalesce(topic_type, 'concept')) as kind from topic group by all),
ev as (select doc_id, topic_ix, '<' || kind || ' class="r"><title class="- topic/title ">' || {_T} || '</title><shortdesc>' || {_S} || '</shortdesc><uicontrol class="+ topic/ph ui-d/uicontrol ">' || case when topic_ix = 0 then '<option class="+ topic/keyword pr-d/option "/>' else '' end || '</uicontrol></' || kind || '>' as expected,
 '<' || case when (doc_id + topic_ix) % 5 = 0 then 'concept' else kind end || ' class="r"><title class="- topic/title ">' || {_T} || '</title><p>' || {esc_sql("substring(coalesce(shortdesc, ''), 1, 40)")} || '</p><uicontrol class="+ topic/ph ui-d/uicontrol "/>'
 || case when (doc_id * 3 + topic_ix) % 7 = 0 then '' else '</' || case when (doc_id + topic_ix) % 5 = 0 then 'concept' else kind end || '>' end as actual, (doc_id * 3 + topic_ix) % 7 <> 0 as valid from fr),
ft as (select doc_id, topic_ix * 2 as topic_ix, expected as xml from ev union all select doc_id, topic_ix * 2 + 1, actual from ev)"""
_METRICS = f"""with {_MAPS}, {_EXPECTED_MAPS}, {_PAIRED}, {_NODES}, {_DEPTHS}, {_COUNTS},
sg as (select doc_id, topic_ix // 2 as k, depth, tag, count(*) filter (topic_ix % 2 = 0) as e, count(*) filter (topic_ix % 2 = 1) as a from dp group by all),
sf as (select doc_id, k, sum(least(e, a)) as c, sum(e) as e, sum(a) as a from sg group by doc_id, k),
wd as (select doc_id, topic_ix, {{words}} as w from ft),
wp as (select e.doc_id, e.topic_ix, len(list_intersect(e.w, a.w)) as c, len(e.w) as e, len(a.w) as a from wd e join wd a on a.doc_id = e.doc_id and a.topic_ix = e.topic_ix + 1 where e.topic_ix % 2 = 0),
sc as (select tag, sum(n) filter (topic_ix % 2 = 0) as e, sum(n) filter (topic_ix % 2 = 1) as a from ec where tag in ('{"', '".join(V.SEMANTIC)}') group by tag),
m as (select 'well-formedness' as metric, avg(valid::int) as score from ev
 union all select 'class coverage', count(class) / count(*) from nd where topic_ix % 2 = 1 and not closes
 union all select 'topic type', avg((regexp_extract(expected, '<([a-z]+)', 1) = regexp_extract(actual, '<([a-z]+)', 1))::int) from ev
 union all select 'structure', avg(2 * c / (e + a)) from sf
 union all select 'semantic elements', count(*) filter (e > 0 and a > 0) / greatest(count(*) filter (e > 0), 1) from sc
 union all select 'words', avg(case when c = 0 then 0 else 2 * (c / greatest(a, 1)) * (c / greatest(e, 1)) / (c / greatest(a, 1) + c / greatest(e, 1)) end) from wp
 union all select 'map', avg(score) from mm)""".replace("{words}", _WORDS)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "topic").groupBy(*KEYS).agg(F.min(F.coalesce("title", F.lit(""))).alias("title"), F.min(F.coalesce("shortdesc", F.lit(""))).alias("shortdesc"), F.min(F.coalesce("topic_type", F.lit("concept"))).alias("kind"))
    other = F.when((F.col("doc_id") + F.col("topic_ix")) % 5 == 0, "concept").otherwise(F.col("kind"))
    begin = lambda kind: F.concat(F.lit("<"), kind, F.lit(' class="r"><title class="- topic/title ">'), T.html_escape(F.col("title")), F.lit("</title>"))
    end = lambda kind: F.concat(F.lit("</"), kind, F.lit(">"))
    option = F.when(F.col("topic_ix") == 0, '<option class="+ topic/keyword pr-d/option "/>').otherwise("")
    expected = F.concat(begin(F.col("kind")), F.lit("<shortdesc>"), T.html_escape(F.col("shortdesc")), F.lit('</shortdesc><uicontrol class="+ topic/ph ui-d/uicontrol ">'), option, F.lit("</uicontrol>"), end(F.col("kind")))
    actual = F.concat(begin(other), F.lit("<p>"), T.html_escape(F.substring("shortdesc", 1, 40)), F.lit('</p><uicontrol class="+ topic/ph ui-d/uicontrol "/>'), F.when((F.col("doc_id") * 3 + F.col("topic_ix")) % 7 == 0, "").otherwise(end(other)))
    return t.select(*KEYS, "kind", expected.alias("expected"), actual.alias("actual"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return V.evaluate(_pairs(spark, sf), V.map_metrics(expected_maps(spark, sf), b2_maps(spark, sf), ["doc_id"]), KEYS)


@query("g16_metrics", _METRICS + " select metric, round(score, 9) as score from m")
def g16_metrics(spark, sf):
    """G10 to G16 together: all metrics of pairs of files with mixed faults, and of the maps."""
    return _metrics(spark, sf).withColumn("score", F.round("score", 9))


@query("g16_overall", _METRICS + " select count(*) as metrics, round(avg(score), 9) as overall from m")
def g16_overall(spark, sf):
    return _metrics(spark, sf).agg(F.count("*").alias("metrics"), F.round(F.avg("score"), 9).alias("overall"))


_LINE = "case when score * 100 >= 90 then '✓' when score * 100 >= 70 then '~' else '✗' end || ' ' || metric || ' ' || repeat('#', floor(score * 100 / 5)::int) || repeat('.', 20 - floor(score * 100 / 5)::int) || ' ' || printf('%.1f', score * 100) || '%'"


@query(
    "b11_report",
    _METRICS + f", r as (select list_position([{', '.join(repr(m) for m in V.METRICS)}], metric) as place, metric, score from m union all select {len(V.METRICS) + 1}, 'overall', avg(score) from m) select place, {_LINE} as line from r",
)
def b11_report(spark, sf):
    return V.report(_metrics(spark, sf))


@query(
    "b4_evaluation_json",
    _METRICS + """ select '{"overall":' || round((select avg(score) from m), 4) || ',"metrics":[' || string_agg('{"metric":"' || metric || '","score":' || round(score, 4) || '}', ',' order by metric) || ']}' as json from m""",
)
def b4_evaluation_json(spark, sf):
    return V.evaluation_json(_metrics(spark, sf))


@query("a9_topic_roots", f"with {_FILES} select distinct doc_id, topic_ix, filename, regexp_extract(regexp_replace(regexp_replace(xml, '<!DOCTYPE[^>]+>', '', 'g'), '<\\?.*?\\?>', '', 'g'), '<([A-Za-z]+)', 1) as root from files")
def a9_topic_roots(spark, sf):
    """Emitted files read again without doctype."""
    bare = F.regexp_replace(T.strip_doctype(F.col("xml")), r"<\?.*?\?>", "")
    return files(spark, sf).select("doc_id", "topic_ix", "filename", F.regexp_extract(bare, "<([A-Za-z]+)", 1).alias("root")).distinct()


@query("a10_match_files", "select doc_id, case substring(filename, 1, 2) when 'c_' then 'concept' when 't_' then 'task' when 'r_' then 'reference' end as kind, max(filename) as filename from out_file where substring(filename, 1, 2) in ('c_', 't_', 'r_') group by all")
def a10_match_files(spark, sf):
    """One file per document and type, the last by name."""
    return V.match_files(table(spark, sf, "out_file").select("doc_id", "filename"), ["doc_id"])


@query("g10_validity", f"with {_PAIRED} select kind as topic_type, count(*) as total, count(*) filter (valid) as valid from fr join ev using (doc_id, topic_ix) group by kind")
def g10_validity(spark, sf):
    """Well-formed files by type, by a real parser; every seventh file lacks its last end tag."""
    return _pairs(spark, sf).groupBy(F.col("kind").alias("topic_type")).agg(F.count("*").alias("total"), F.count_if(X.well_formed(F.col("actual"))).alias("valid"))


#: A body for each rule of the content model, and what it becomes; T stands for the title of the topic.
_RULES = (
    ("<conbody><section><p>s</p></section><p>T</p></conbody>", "<conbody><p>T</p><section><p>s</p></section></conbody>"),
    ("<conbody>T <b>x</b> tail</conbody>", '<conbody><p class="- topic/p ">T <b>x</b> tail</p></conbody>'),
    ("<conbody>T<p>x</p>tail</conbody>", '<conbody><p class="- topic/p ">T</p><p>x</p><p class="- topic/p ">tail</p></conbody>'),
    ("<refbody><p>T</p><section><p>b</p></section></refbody>", '<refbody><section class="- topic/section "><p>T</p></section><section><p>b</p></section></refbody>'),
    ("<taskbody><p>pre</p><steps><step><cmd>c</cmd><codeblock>T</codeblock></step></steps><p>post</p></taskbody>",
     '<taskbody><context class="- topic/section task/context "><p>pre</p></context><steps><step><cmd>c</cmd><info class="- topic/itemgroup task/info "><codeblock>T</codeblock></info></step></steps><result class="- topic/section task/result "><p>post</p></result></taskbody>'),
    ("<taskbody><result>r</result><section><title>An example</title><p>T</p></section><steps><step>T</step></steps></taskbody>",
     '<taskbody><steps><step><cmd class="- topic/ph task/cmd ">T</cmd></step></steps><result><p class="- topic/p ">r</p></result><example class="- topic/section task/example "><title>An example</title><p>T</p></example></taskbody>'),
    ("<conbody><section><section><p>n</p></section><p>T</p></section></conbody>", "<conbody><section><p>T</p></section><section><p>n</p></section></conbody>"),
    ("<conbody><p>T</p></conbody>", "<conbody><p>T</p></conbody>"),
    ("<conbody><p>T", "<conbody><p>T</p></conbody>"),
    ('<refbody><section><p class="q" "T</p><table><tgroup cols="1"><thead/></tgroup></table></section></refbody>', f'<refbody><section><p class="q">T</p><table><tgroup cols="1"><thead/>{T.EMPTY_TBODY}</tgroup></table></section></refbody>'),
)
_CHOSEN = "(doc_id * 7 + topic_ix) % 10"
_RULED = "case " + _CHOSEN + " " + " ".join(f"when {i} then replace('{b}', 'T', t)" for i, (_, b) in enumerate(_RULES)) + " end"


@query("x2_content_rules", f"with tt as (select distinct doc_id, topic_ix, replace({esc_sql("'A ' || coalesce(title, '')")}, 'T', 't') as t from topic) select doc_id, topic_ix, {_RULED} as body_xml, true as valid from tt")
def x2_content_rules(spark, sf):
    """A body for each rule of the content model, with the title of the topic in it."""
    t = table(spark, sf, "topic").select("doc_id", "topic_ix", F.translate(T.html_escape(F.concat(F.lit("A "), F.coalesce("title", F.lit("")))), "T", "t").alias("t")).distinct()
    body = F.lit("")
    for i, (a, _) in enumerate(_RULES):
        body = F.when((F.col("doc_id") * 7 + F.col("topic_ix")) % 10 == i, F.replace(F.lit(a), F.lit("T"), F.col("t"))).otherwise(body)
    fixed = t.select("doc_id", "topic_ix", X.fix_content_model(body).alias("body_xml"))
    return fixed.withColumn("valid", X.well_formed(F.col("body_xml")))


_PRETTY = """'<conbody>' || chr(10) || '  <p>' || t || '<b/><i>x</i></p>' || chr(10) || case when topic_ix % 2 = 0 then '  <section>' || chr(10) || '    <p>' || t || '</p>' || chr(10) || '  </section>' else '  <note/>' end || chr(10) || '</conbody>'"""


@query("x10_pretty_print", f"with tt as (select distinct doc_id, topic_ix, {esc_sql("'A ' || coalesce(title, '')")} as t from topic) select doc_id, topic_ix, case topic_ix % 3 when 2 then '<conbody><p>' || t else {_PRETTY} end as xml from tt")
def x10_pretty_print(spark, sf):
    """Markup indented where elements hold nothing but elements; broken markup stays."""
    t = T.html_escape(F.concat(F.lit("A "), F.coalesce("title", F.lit(""))))
    tail = F.when(F.col("topic_ix") % 2 == 0, F.concat(F.lit("<section> <p>"), t, F.lit("</p></section>"))).otherwise("<note></note>")
    xml = F.when(F.col("topic_ix") % 3 == 2, F.concat(F.lit("<conbody><p>"), t)).otherwise(F.concat(F.lit("<conbody>\n<p>"), t, F.lit("<b/><i>x</i></p>"), tail, F.lit("</conbody>")))
    return table(spark, sf, "topic").select("doc_id", "topic_ix", xml.alias("xml")).distinct().withColumn("xml", X.pretty_print(F.col("xml")))


@query("x1_content_model")
def x1_content_model(spark, sf):
    """Bodies repaired to the content model, and whether they changed and parse now."""
    t = table(spark, sf, "topic").where("body_xml is not null").select("doc_id", "topic_ix", "body_xml").distinct()
    fixed = t.withColumn("fixed", X.fix_content_model(F.col("body_xml")))
    return fixed.select("doc_id", "topic_ix", F.col("fixed").alias("body_xml"), (F.col("fixed") != F.col("body_xml")).alias("changed"), X.well_formed(F.col("fixed")).alias("valid"))
