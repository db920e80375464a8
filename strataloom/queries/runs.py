"""Queries of run analytics on stage events, files and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom import annotators
from strataloom.functions.text import asset_versions, slug, version_numbers
from strataloom.operators import emit as E
from strataloom.operators import runs as R
from strataloom.plans.tables import table
from strataloom.queries.registry import query, slug_sql
from strataloom.queries.topics import _FILES, _MAPS, b2_maps, files, topic_table
from strataloom.sources import sinks
from strataloom.sources.files import log_summary, salvage_plan, salvage_reply
from strataloom.streaming import progress

_EV = "ev as (select distinct client_id, name, status, time, detail, ts from stage_event)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "stage_event").select("client_id", "name", "status", "time", "detail", "ts").distinct()


_LATEST = _EV + ", la as (select client_id, name, (m).s as status, (m).t as time, (m).ts as ts from (select client_id, name, arg_max({'s': status, 't': time, 'ts': ts}, (ts, coalesce(status, ''), coalesce(time, -1.0))) as m from ev group by all))"


@query("t2_latest_stages", f"with {_LATEST} select * from la")
def t2_latest_stages(spark, sf):
    """Newest row of each client and stage."""
    return R.latest_stages(events(spark, sf))


@query("w13_active_stage", f"with {_LATEST} select client_id, arg_min(name, list_position(['parse', 'group', 'plan', 'classify', 'emit', 'validate'], name)) filter (coalesce(status, '') not in ('done', 'error')) as active from la group by client_id")
def w13_active_stage(spark, sf):
    return R.active_stage(R.latest_stages(events(spark, sf)))


@query("j14_stage_view", f"with {_LATEST} select client_id, name, status, time, ts, case name when 'parse' then 'ingest' when 'group' then 'normalize' when 'plan' then 'detect' when 'classify' then 'transform' when 'emit' then 'export' else 'validate' end as step from la where name in ('parse', 'group', 'plan', 'classify', 'emit', 'validate')")
def j14_stage_view(spark, sf):
    return R.stage_view(R.latest_stages(events(spark, sf)))


@query("g18_run_summary", f"with {_EV} select client_id, count(*) as stages, count(*) filter (status = 'done') as done, count(*) filter (status = 'error') as failed, round(sum(coalesce(time, 0.0)), 3) as seconds from ev group by client_id")
def g18_run_summary(spark, sf):
    """Totals by client."""
    return R.run_summary(events(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@query("g26_history", f"with {_EV} select client_id, name, ts, status from ev order by ts desc, client_id, name, coalesce(status, '') limit 10")
def g26_history(spark, sf):
    """G26, L: the ten newest rows, newest first (a top-k report)."""
    return events(spark, sf).select("client_id", "name", "ts", "status").orderBy(F.desc("ts"), "client_id", "name", F.coalesce("status", F.lit(""))).limit(10)


@query("g26_totals", f"with {_EV} select count(*) as total, count(*) filter (status = 'done') as passed, round(avg(time), 6) as mean_time from ev")
def g26_totals(spark, sf):
    return events(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("passed"), F.round(F.avg("time"), 6).alias("mean_time"))


@query(
    "b3_batch_report",
    f"""with {_EV}, g as (select client_id, count(*) as n, count(*) filter (status = 'done') as d, count(*) filter (status = 'error') as e, sum(coalesce(time, 0.0)) as s from ev group by client_id)
select client_id as client, '{{"client":"' || client_id || '","stages":' || n || ',"done":' || d || ',"failed":' || e || '}}' as json from g
union all select null, '{{"total":' || count(*) || ',"passed":' || count(*) filter (e = 0) || ',"seconds":' || case when round(sum(s), 2) >= 1e7 then null else round(sum(s), 2) end || '}}' from g""",
)
def b3_batch_report(spark, sf):
    """A line per run and the totals."""
    return sinks.batch_report(R.run_summary(events(spark, sf)))


@query("b5_summary_lines", f"with {_EV} select client_id, name, case when bool_and(coalesce(status, '') <> 'error') then 'PASS' else 'FAIL' end || chr(9) || client_id || '/' || name || chr(9) || count(*) || chr(9) || 'errs=' || count(*) filter (status = 'error') as line from ev group by client_id, name")
def b5_summary_lines(spark, sf):
    """Tab-separated summary lines."""
    g = events(spark, sf).groupBy("client_id", "name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("e"))
    return g.select("client_id", "name", F.concat_ws("\t", F.when(F.col("e") == 0, "PASS").otherwise("FAIL"), F.concat("client_id", F.lit("/"), "name"), F.col("n").cast("string"), F.concat(F.lit("errs="), F.col("e").cast("string"))).alias("line"))


@query("a15_log_scan", f"with {_EV} select name, regexp_extract(coalesce(detail, ''), '([0-9]+) items', 1) as items, count(*) as n from ev where regexp_matches(coalesce(detail, ''), '[0-9]+ items') group by all")
def a15_log_scan(spark, sf):
    """Values read from log details."""
    ev = events(spark, sf).where(F.col("detail").rlike("[0-9]+ items"))
    return ev.groupBy("name", F.regexp_extract("detail", "([0-9]+) items", 1).alias("items")).agg(F.count("*").alias("n"))


_LOGS = f"""{_EV}, g as (select client_id || '/' || name as run, count(*) filter (status = 'error') as e, count(*) as n from ev where name is not null group by all),
lg as (select run, 'begin' || chr(10) || case when e = 0 then '  VALIDATION:   PASS' when e < 3 then 'VALIDATION: FAIL' when e = 3 then 'VALIDATION: N/A' else 'no word' end || repeat(chr(10) || '  ✗ bad', e::int) || chr(10) || ' ✗ none' as text, n % 3 as code, e from g)"""


@query(
    "a15_log_results",
    f"""with {_LOGS}, r as (select run, case when e = 0 then 'PASS' when e < 3 then 'FAIL' when e = 3 then 'N/A' else '?' end as result, e::int as errors, e = 0 and code = 0 as passed from lg)
select run, result, errors, passed, case when passed then 'PASS' else 'FAIL' end || chr(9) || run || chr(9) || result || chr(9) || 'errs=' || errors as line from r""",
)
def a15_log_results(spark, sf):
    """Results and error lines read from logs that are made of the events of each client's stage."""
    g = events(spark, sf).where("name is not null").groupBy(F.concat_ws("/", "client_id", "name").alias("run")).agg(F.count_if(F.col("status") == "error").cast("int").alias("e"), F.count("*").alias("n"))
    word = F.when(F.col("e") == 0, "  VALIDATION:   PASS").when(F.col("e") < 3, "VALIDATION: FAIL").when(F.col("e") == 3, "VALIDATION: N/A").otherwise("no word")
    text = F.concat(F.lit("begin\n"), word, F.repeat(F.lit("\n  ✗ bad"), F.col("e")), F.lit("\n ✗ none"))
    return log_summary(g.select("run", text.alias("text"), (F.col("n") % 3).alias("code")), "run")


@query("t5_sessions", f"""with {_EV}, f as (select *, (ts - lag(ts) over (partition by client_id order by ts)) > interval 1 hour as gap from (select distinct client_id, ts from ev)),
s as (select client_id, ts, sum(coalesce(gap, false)::int) over (partition by client_id order by ts rows unbounded preceding) as sid from f)
select client_id, min(ts) as started, max(ts) as ended, count(*) as n from s group by client_id, sid""")
def t5_sessions(spark, sf):
    """T5: sessions of a client, ended by an hour of silence; session windows combine partial sessions before the shuffle."""
    ev = events(spark, sf).select("client_id", "ts").distinct()
    g = ev.groupBy("client_id", F.session_window("ts", "3600 seconds 1 microsecond")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return g.select("client_id", "started", "ended", "n")


@query("t9_once_per_stage", f"with {_EV} select client_id, name, min(ts) as first_done from ev where status = 'done' group by all")
def t9_once_per_stage(spark, sf):
    """Each stage logged once, when first done."""
    return events(spark, sf).where("status = 'done'").groupBy("client_id", "name").agg(F.min("ts").alias("first_done"))


@query("g25_type_summary", "with t as (select distinct doc_id, topic_ix, topic_type from out_file) select doc_id, concat_ws(', ', case when c > 0 then 'concept x' || c end, case when t > 0 then 'task x' || t end, case when r > 0 then 'reference x' || r end) as summary from (select doc_id, count(*) filter (topic_type = 'concept') as c, count(*) filter (topic_type = 'task') as t, count(*) filter (topic_type = 'reference') as r from t group by doc_id)")
def g25_type_summary(spark, sf):
    return R.type_summary(table(spark, sf, "out_file").select("doc_id", "topic_ix", "topic_type").distinct())


#: Bodies with something for every feature, by document; maps are missing for every sixth document.
_SEEDS = ("<p>Sent via mail, e.g. daily</p>", '<p><xref href="a"/></p>', '<image href="a"><alt>t</alt></image>', '<image href="b"/>')
_SEEDED = _FILES.replace("coalesce(body_xml, ''),", "coalesce(body_xml, '') || ([" + ", ".join(f"'{x}'" for x in _SEEDS) + "])[doc_id % 4 + 1],")
_CHECK = r"""g as (select doc_id, count(*) as topics, count(*) filter (regexp_matches(xml, '<(concept|task|reference)\s')) as typed, count(*) filter (regexp_matches(xml, '<tgroup\b')) as tables,
 sum(len(regexp_extract_all(xml, '\b(?:via|i\.e\.|e\.g\.|etc\.)'))) as ab, sum(len(regexp_extract_all(xml, '<shortdesc\b'))) as sd, sum(len(regexp_extract_all(xml, '<keywords class='))) as kw,
 sum(len(regexp_extract_all(xml, '<xref\b'))) as xr, sum(len(regexp_extract_all(xml, '<image\b'))) as im, sum(len(regexp_extract_all(xml, '<alt\b'))) as al from files group by doc_id),
mc as (select doc_id, count(*) as maps, count(*) filter (contains(xml, 'keys="product-name"')) as pr from maps where doc_id % 6 <> 0 group by doc_id),
ic as (select doc_id, count(distinct pos) as n from block where type = 'image' group by doc_id)"""


@query(
    "g19_checklist",
    f"""with {_SEEDED}, {_MAPS}, {_CHECK} select g.doc_id, unnest(range(1, 12))::int as place, unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'j', 'k']) as feature,
unnest([case when typed > 0 then 'pass' else 'fail' end, case when maps > 0 then 'pass' else 'fail' end, case when tables > 0 then 'pass' else 'warn' end, case when ab = 0 then 'pass' else 'fail' end,
 case when sd = topics then 'pass' else 'warn' end, case when pr > 0 then 'pass' else 'warn' end, case when kw = topics then 'pass' else 'warn' end, case when xr > 0 then 'pass' else 'warn' end,
 case when ic.n > 0 then 'pass' else 'warn' end, case when im = 0 then 'warn' when al = im then 'pass' else 'fail' end, 'pass']) as status from g left join mc using (doc_id) left join ic using (doc_id)""",
)
def g19_checklist(spark, sf):
    """The features of each document, from its topics, its map and its images."""
    seed = F.element_at(F.array(*map(F.lit, _SEEDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    t = E.topic_files(topic_table(spark, sf).withColumn("body_xml", F.concat(F.coalesce("body_xml", F.lit("")), seed)))
    return R.checklist(t, b2_maps(spark, sf).where("doc_id % 6 <> 0"), R.image_cap_audit(_image_sizes(spark, sf)), "doc_id")


@query("g20_richness", f"with {_FILES} select doc_id, " + ", ".join(f"sum(len(regexp_extract_all(xml, '<{t}\\b')))::bigint as {t}" for t in ("uicontrol", "menucascade", "wintitle", "option", "codeblock", "note")) + " from files group by doc_id")
def g20_richness(spark, sf):
    tags = ("uicontrol", "menucascade", "wintitle", "option", "codeblock", "note")
    return files(spark, sf).groupBy("doc_id").agg(*(F.sum(F.regexp_count("xml", F.lit(rf"<{t}\b"))).cast("bigint").alias(t) for t in tags))


@query("g21_types_seen", f"with {_FILES} select doc_id, string_agg(distinct regexp_extract(xml, '<(concept|task|reference)\\s', 1), ',' order by regexp_extract(xml, '<(concept|task|reference)\\s', 1)) as types from files group by doc_id")
def g21_types_seen(spark, sf):
    t = files(spark, sf).select("doc_id", F.regexp_extract("xml", r"<(concept|task|reference)\s", 1).alias("t")).distinct()
    return t.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("types"))


@query("g17_run_quality", """with ft as (select doc_id, topic_ix, min(body_xml) as xml from topic where body_xml is not null group by all), d as (select unnest(regexp_extract_all(xml, 'class="[^"]*(?:ui-d|pr-d)/([A-Za-z0-9_]+)', 1)) as domain from ft)
select domain, count(*) as n, (row_number() over (order by count(*) desc, domain))::int as place from d group by domain""")
def g17_run_quality(spark, sf):
    """Domain elements over all topics, the most frequent first."""
    t = table(spark, sf, "topic").where("body_xml is not null").groupBy("doc_id", "topic_ix").agg(F.min("body_xml").alias("xml"))
    return R.domain_ranks(t.select(F.explode(F.regexp_extract_all("xml", F.lit('class="[^"]*(?:ui-d|pr-d)/([A-Za-z0-9_]+)'), 1)).alias("domain")))


def _image_sizes(spark, sf):
    return table(spark, sf, "block").where("type = 'image'").select("doc_id", "pos", (F.col("pos") * 97 % 2000).cast("bigint").alias("width"), (F.length(F.coalesce("text", F.lit(""))) * 7919).cast("bigint").alias("bytes")).distinct()


_SIZES = "i as (select distinct doc_id, pos, (pos * 97 % 2000)::bigint as width, (length(coalesce(text, '')) * 7919)::bigint as bytes from block where type = 'image')"


@query("g22_image_caps", f"with {_SIZES} select doc_id, count(*) filter (width <= 1000 and bytes <= 204800) as ok, count(*) filter (not (width <= 1000 and bytes <= 204800)) as bad from i group by doc_id")
def g22_image_caps(spark, sf):
    """G22 on made-up sizes."""
    return R.image_cap_audit(_image_sizes(spark, sf))


@query(
    "f34_image_work",
    f"""with {_SIZES}, n as (select *, 'fig' || pos || case pos % 3 when 0 then '.PNG' when 1 then '.jpg' else '.png' end as name, case when pos % 11 = 0 then null else width end as w from i)
select doc_id, pos, name, case when w > 1000 then 1000 else 0 end as new_width, bytes > 204800 and w is not null as recode, case when bytes > 204800 and w is not null and pos % 3 <> 1 then 'fig' || pos || '.jpg' else name end as new_name from n""",
)
def f34_image_work(spark, sf):
    """which images have to be narrowed or encoded anew, and under which name; made-up sizes, some unreadable."""
    ending = F.when(F.col("pos") % 3 == 0, ".PNG").when(F.col("pos") % 3 == 1, ".jpg").otherwise(".png")
    i = _image_sizes(spark, sf).select("doc_id", "pos", F.concat(F.lit("fig"), F.col("pos").cast("string"), ending).alias("name"), F.when(F.col("pos") % 11 != 0, F.col("width")).alias("width"), "bytes")
    return R.image_work(i).select("doc_id", "pos", "name", F.coalesce("new_width", F.lit(0)).alias("new_width"), "recode", "new_name")


@query(
    "s8_newest_version",
    """with p as (select distinct topic_type, '/opt/jdk-17.0.' || doc_id % 23 || '+' || topic_ix as path from out_file),
v as (select *, list_transform(regexp_extract_all(path, '[0-9]+'), lambda n: n::bigint) as v from p) select topic_type, arg_max(path, v) as path from v group by topic_type""",
)
def s8_newest_version(spark, sf):
    """The newest of several installed versions, by their numbers and not their spelling; made-up paths."""
    p = table(spark, sf, "out_file").select("topic_type", F.format_string("/opt/jdk-17.0.%d+%d", F.col("doc_id") % 23, "topic_ix").alias("path")).distinct()
    return p.groupBy("topic_type").agg(F.max_by("path", version_numbers(F.col("path"))).alias("path"))


@query("b9_bundles", f"with {_FILES}, k as (select doc_id, topic_ix // 4 as volume, topic_ix, filename, xml from files) select doc_id, volume::int as volume, filename as name, arg_max(xml, topic_ix) as text from k group by doc_id, volume, filename")
def b9_bundles(spark, sf):
    """Topic files put into zip volumes of four topics, and read out of them again."""
    return sinks.unbundle(sinks.bundles(files(spark, sf), volume_topics=4))


@query("b10_find_files", """with o as (select distinct doc_id, topic_ix, filename from out_file) select doc_id, topic_ix, case topic_ix % 5 when 0 then filename when 1 then 'a/./../' || filename when 2 then '../' || filename when 3 then 'none.dita' else '/' || filename end as path,
case when topic_ix % 5 < 2 then filename end as filename, case topic_ix % 5 when 0 then 200 when 1 then 200 when 3 then 404 else 403 end as status from o""")
def b10_find_files(spark, sf):
    """Files asked for by path: found, missing, or outside the folder."""
    o = table(spark, sf, "out_file").select("doc_id", "topic_ix", "filename").distinct()
    case = F.col("topic_ix") % 5
    path = F.when(case == 0, F.col("filename")).when(case == 1, F.concat(F.lit("a/./../"), "filename")).when(case == 2, F.concat(F.lit("../"), "filename")).when(case == 3, "none.dita").otherwise(F.concat(F.lit("/"), "filename"))
    return E.find_files(o.select("doc_id", "topic_ix", path.alias("path")), o)


@query("f36_asset_versions", """select distinct doc_id, topic_ix, '<script src="' || filename || '.js?v=' || doc_id || '"></script><link href="a/x.css?v=' || doc_id || '"><a href="' || filename || '">' as html from out_file""")
def f36_asset_versions(spark, sf):
    """scripts and style sheets of a page under a new version."""
    html = F.concat(F.lit('<script src="'), "filename", F.when(F.col("topic_ix") % 2 == 0, '.js?v=old"').otherwise('.js"'), F.lit('></script><link href="a/x.css"><a href="'), "filename", F.lit('">'))
    return table(spark, sf, "out_file").select("doc_id", "topic_ix", asset_versions(html, F.col("doc_id").cast("string")).alias("html")).distinct()


@query("c20_search", "with o as (select distinct doc_id, filename from out_file) select d.doc_id from (select doc_id, max(title) as title from documents group by doc_id) d where contains(lower(coalesce(title, '')), 'ledger') or doc_id in (select doc_id from o where contains(lower(filename), 'ledger'))")
def c20_search(spark, sf):
    """C20: documents whose title or any file name holds a word."""
    hit = table(spark, sf, "out_file").where(F.contains(F.lower("filename"), F.lit("ledger"))).select(F.col("doc_id").alias("_d")).distinct()
    d = table(spark, sf, "documents").groupBy("doc_id").agg(F.max("title").alias("title"))
    return d.join(hit, F.col("doc_id") == F.col("_d"), "left").where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("ledger")) | F.col("_d").isNotNull()).select("doc_id")


@query("c21_uploads", "select source, count(*) as n from documents where ends_with(lower(source || case when doc_kind = 'export' then '.XML' else '.PDF' end), '.pdf') group by source")
def c21_uploads(spark, sf):
    name = F.concat("source", F.when(F.col("doc_kind") == "export", ".XML").otherwise(".PDF"))
    return table(spark, sf, "documents").where(F.endswith(F.lower(name), F.lit(".pdf"))).groupBy("source").agg(F.count("*").alias("n"))


@query("j12_file_plan", f"with o as (select distinct doc_id, topic_ix, filename from out_file), p as (select distinct doc_id, topic_ix as plan_ix, topic_title from topic_plan) select o.doc_id, o.topic_ix, filename, arg_min(topic_title, plan_ix) as title from o left join p on p.doc_id = o.doc_id and contains(filename, substring({slug_sql('topic_title')}, 1, 30)) group by all")
def j12_file_plan(spark, sf):
    """The first plan whose slug is part of the file name; an equi join on the document bounds the theta join."""
    o = table(spark, sf, "out_file").select("doc_id", "topic_ix", "filename").distinct()
    p = table(spark, sf, "topic_plan").select(F.col("doc_id").alias("_d"), F.col("topic_ix").alias("plan_ix"), "topic_title").distinct()
    j = o.join(p, (F.col("doc_id") == F.col("_d")) & F.contains("filename", F.substring(slug(F.col("topic_title")), 1, 30)), "left")
    return j.groupBy("doc_id", "topic_ix", "filename").agg(F.min_by("topic_title", "plan_ix").alias("title"))


@query("j13_zip", "with o as (select distinct doc_id, topic_ix, filename from out_file), p as (select distinct doc_id, topic_ix, topic_title from topic_plan) select doc_id, topic_ix, filename, topic_title from o join p using (doc_id, topic_ix)")
def j13_zip(spark, sf):
    """Inputs and results put together by place."""
    o = table(spark, sf, "out_file").select("doc_id", "topic_ix", "filename").distinct()
    return o.join(table(spark, sf, "topic_plan").select("doc_id", "topic_ix", "topic_title").distinct(), ["doc_id", "topic_ix"])


@query("events_by_window", "select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_by_window(spark, sf):
    """Tumbling windows over the event stream (batch form of the streaming query)."""
    ev = table(spark, sf, "events")
    return ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("f24_salvage_replies", """with t as (select distinct doc_id, topic_ix, coalesce(title, '') as title, topic_type from topic where topic_type is not null)
select doc_id, topic_ix, case (doc_id + topic_ix) % 4 when 3 then 'concept' else topic_type end as topic_type, case (doc_id + topic_ix) % 4 when 3 then title when 2 then 'S' else 'S' end as shortdesc from t""")
def f24_salvage_replies(spark, sf):
    """replies made from the topics: strict, fenced with chatter, with unescaped quotes, and unreadable."""
    t = table(spark, sf, "topic").where("topic_type is not null").select("doc_id", "topic_ix", F.coalesce("title", F.lit("")).alias("title"), "topic_type").distinct()
    good = F.concat(F.lit('{"topic_type": "'), "topic_type", F.lit('", "shortdesc": "S", "keywords": ["a"], "body_xml": "<conbody>x</conbody>"}'))
    broken = F.concat(F.lit('{"topic_type": "'), "topic_type", F.lit('", "shortdesc": "S", "keywords": ["a"], "body_xml": "<conbody class="q">x</conbody>"}'))
    case = (F.col("doc_id") + F.col("topic_ix")) % 4
    reply = F.when(case == 0, good).when(case == 1, F.concat(F.lit("```json\nHere it is: "), good, F.lit("\n```"))).when(case == 2, broken).otherwise("no reply")
    r = t.withColumn("r", salvage_reply(reply, F.col("title")))
    return r.select("doc_id", "topic_ix", "r.topic_type", "r.shortdesc")


_PLANS = """t as (select distinct doc_id, topic_ix, topic_title, topic_type, section_indices, reasoning from topic_plan),
x as (select *, row_number() over (partition by doc_id order by topic_ix, topic_title, reasoning, section_indices::varchar) - 1 as k from t)"""


@query("f25_salvage_plans", f"with {_PLANS} select doc_id, k::int as k, topic_title, topic_type, case when doc_id % 3 = 2 then k::varchar else array_to_string(section_indices, ',') end as sections, case when doc_id % 3 = 2 then 'fallback' else reasoning end as reasoning from x")
def f25_salvage_plans(spark, sf):
    """replies made from the stored plans: strict, with chatter around, and unreadable, which gives a topic per section."""
    row = F.struct("topic_ix", "topic_title", F.col("reasoning"), F.col("section_indices").cast("string").alias("s"), "topic_type", "section_indices")
    g = table(spark, sf, "topic_plan").select("doc_id", "topic_ix", "topic_title", "topic_type", "section_indices", "reasoning").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("l"))  # topics of one document
    plan = F.to_json(F.transform("l", lambda x: F.struct(x["topic_title"].alias("topic_title"), x["topic_type"].alias("topic_type"), x["section_indices"].alias("section_indices"), x["reasoning"].alias("reasoning"))))
    reply = F.when(F.col("doc_id") % 3 == 0, plan).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\nHere: "), plan, F.lit(" as asked\n```"))).otherwise(F.concat(F.lit("[{"), plan))
    heads = F.transform("l", lambda x: F.struct(x["topic_title"].alias("title"), x["topic_type"].alias("topic_type")))
    out = g.select("doc_id", F.posexplode(salvage_plan(reply, heads)).alias("k", "p"))
    return out.select("doc_id", "k", "p.topic_title", "p.topic_type", F.array_join(F.transform("p.section_indices", lambda i: i.cast("string")), ",").alias("sections"), "p.reasoning")


class _Mending:
    """Takes a forbidden character out of odd bodies at the first try, out of even ones only once asked again, and out of lost ones never."""

    def answer(self, prompts):
        for p in prompts:
            body = p.split("XML to fix:\n", 1)[1]
            keep = "lost" in body or ("even" in body and 'class="again"' not in body)
            yield "```xml\n" + (body.replace("<p>", '<p class="again">') if keep else body.replace("\x01", "")) + "\n```"


@query("x12_repair_loop", """with t as (select distinct doc_id, topic_ix from topic) select doc_id, topic_ix, (doc_id + topic_ix) % 5 <> 4 as valid, case (doc_id + topic_ix) % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 1 else 2 end as tries,
case when (doc_id + topic_ix) % 5 = 4 then 'not well-formed after 2 repairs' end as error from t""")
def x12_repair_loop(spark, sf):
    """Broken bodies are repaired by an annotator, at most twice; those that stay broken become rows with an error."""
    case = (F.col("doc_id") + F.col("topic_ix")) % 5
    body = F.concat(F.lit("<conbody><p>"), F.when(case == 0, "fine").when(case == 2, "even\x01").when(case == 4, "lost\x01").otherwise("odd\x01"), F.lit("</p></conbody>"))
    t = table(spark, sf, "topic").select("doc_id", "topic_ix").distinct().withColumn("body_xml", body)
    return annotators.repair(t, _Mending()).select("doc_id", "topic_ix", "valid", "tries", "error")


@query("u1_multiset_overlap", "with b as (select distinct doc_id, pos, type from block), e as (select doc_id, type, count(*) as n from b where pos % 2 = 0 group by all), a as (select doc_id, type, count(*) as n from b where pos % 2 = 1 group by all) select doc_id, sum(least(e.n, a.n))::bigint as common from e join a using (doc_id, type) group by doc_id")
def u1_multiset_overlap(spark, sf):
    """Block types of even and odd positions as multisets, by counts (INTERSECT ALL gives the same rows)."""
    b = table(spark, sf, "block").select("doc_id", "pos", "type").distinct()
    e = b.where("pos % 2 = 0").groupBy("doc_id", "type").agg(F.count("*").alias("e"))
    a = b.where("pos % 2 = 1").groupBy("doc_id", "type").agg(F.count("*").alias("a"))
    return e.join(a, ["doc_id", "type"]).groupBy("doc_id").agg(F.sum(F.least("e", "a")).alias("common"))


@query(
    "t1_event_stream_text",
    """with l as (select client_id || '/' || name || '/' || strftime(ts, '%Y-%m-%d') as key, detail, extract(day from ts) as d, row_number() over (partition by client_id, name, ts::date order by ts, coalesce(status, ''), coalesce(time, -1.0), detail) as n
 from (select distinct client_id, name, status, time, detail, ts from stage_event where detail is not null))
select key, string_agg(detail, '' order by n) as text, case when max(d) % 2 = 1 then 'e1' end as error from l group by key""",
)
def t1_event_stream_text(spark, sf):
    """Event-stream lines made from a day's log of a client's stage, read back in order; comments and bad JSON are skipped, of the errors on odd days the first is kept."""
    ev = table(spark, sf, "stage_event").where("detail is not null").select("client_id", "name", "status", "time", "detail", "ts").distinct()
    ev = ev.withColumn("key", F.concat_ws("/", "client_id", "name", F.date_format("ts", "yyyy-MM-dd")))
    n = F.row_number().over(Window.partitionBy("key").orderBy("ts", F.coalesce("status", F.lit("")), F.coalesce("time", F.lit(-1.0)), "detail"))
    good = F.concat(F.lit('data: {"candidates":[{"content":{"parts":[{"text":"'), "detail", F.lit('"}]}}]}'))
    ev = ev.withColumn("n", n)
    error = F.when(F.dayofmonth("ts") % 2 == 1, F.concat(F.lit('data: {"error":{"message":"e'), F.col("n").cast("string"), F.lit('"}}'))).otherwise(": none")
    return progress.event_stream_text(ev.select("key", "n", F.explode(F.array(good, F.lit(": ping"), F.lit("data: {bad"), error)).alias("line")))


@query("t2_stream_windows", "select time_bucket(interval 10 minutes, ts) as start, time_bucket(interval 10 minutes, ts) + interval 10 minutes as \"end\", name, count(*) as n, round(sum(time), 6) as seconds from stage_event where ts is not null group by all")
def t2_stream_windows(spark, sf):
    """T2 as a stream: stage events into windows, run to the end of the data once; open windows and late rows are in."""
    stream = progress.read_events(spark, f"{sf}/stage_event.parquet")
    return progress.run_to_totals(progress.windowed_counts(stream, lateness="3 days")).withColumn("seconds", F.round("seconds", 6))


@query("t9_stream_once", "select client_id, name, min(ts) as first_done from stage_event where status = 'done' group by all")
def t9_stream_once(spark, sf):
    """T9 as a stream: each stage of a client once, with the time it was first done."""
    return progress.run_to_totals(progress.first_done(progress.read_events(spark, f"{sf}/stage_event.parquet")))


@query(
    "t3_stream_snapshots",
    """with s as (select client_id, name, arg_max(coalesce(status, ''), (ts, coalesce(status, ''))) as status, max(ts) as ts from stage_event where ts is not null and client_id is not null group by client_id, name),
g as (select client_id, count(*)::int as stages, (count(*) filter (status = 'done'))::int as done, arg_max(name, (ts, name)) filter (status not in ('done', 'error')) as active, count(*) filter (status not in ('done', 'error')) = 0 as ended from s group by client_id)
select * from g union all select 'nobody', 0, 0, null, true""",
)
def t3_stream_snapshots(spark, sf):
    """The newest snapshot of each client from the stream of events, and of one that was never seen; stages are kept for ever here."""
    stream = progress.read_events(spark, f"{sf}/stage_event.parquet").where("ts is not null and client_id is not null")
    latest = progress.run_to_latest(progress.snapshots(stream, lateness="3650 days", expiry_ms=None), "client_id")
    clients = table(spark, sf, "stage_event").where("ts is not null and client_id is not null").select("client_id").distinct()
    return progress.poll(latest, clients.unionAll(spark.createDataFrame([("nobody",)], "client_id string")))


@query("c22_error_lines", f"with {_EV}, l as (select client_id, ts, coalesce(detail, '') || case status when 'error' then ' [DOTJ013E]' when 'skipped' then ' [DOTX008W]' else '' end as line from ev) select distinct client_id, ts, line from l where contains(line, '[DOT') and (contains(line, 'E]') or contains(line, 'F]'))")
def c22_error_lines(spark, sf):
    """C22 on log lines made from the events."""
    line = F.concat(F.coalesce("detail", F.lit("")), F.when(F.col("status") == "error", " [DOTJ013E]").when(F.col("status") == "skipped", " [DOTX008W]").otherwise(""))
    return R.error_lines(events(spark, sf).select("client_id", "ts", line.alias("line"))).distinct()


@query("d13_run_stats", """with s as (select doc_id, count(distinct pos) as sections from block where type = 'heading' group by doc_id), t as (select doc_id, count(distinct topic_ix) as topics from topic group by doc_id), f as (select doc_id, count(distinct topic_ix) as files from out_file group by doc_id)
select doc_id, coalesce(sections, 0)::bigint as sections, coalesce(topics, 0)::bigint as topics, coalesce(files, 0)::bigint as files, 0::bigint as failed from s full join t using (doc_id) full join f using (doc_id)""")
def d13_run_stats(spark, sf):
    """Headings, topics and files of each document."""
    s = table(spark, sf, "block").where("type = 'heading'").select("doc_id", "pos").distinct()
    t = table(spark, sf, "topic").select("doc_id", "topic_ix").distinct()
    return R.run_stats(s, t, table(spark, sf, "out_file").select("doc_id", "topic_ix").distinct())
