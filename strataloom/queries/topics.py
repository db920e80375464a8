"""Queries from blocks to sections, topics, bodies, files and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom import annotators
from strataloom.functions import text as T
from strataloom.operators import emit as E
from strataloom.operators import sections as S
from strataloom.plans.tables import table
from strataloom.queries.registry import BLOCKS, SP, WD, esc_sql, name_sql, query, slug_sql, strip_sql, xesc_sql
from strataloom.sources import markdown as M

# -- Markdown -------------------------------------------------------------------------------------------------------

_LINE_ENDS = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"

_MD = f"""
m1 as (select *, {strip_sql('line')} as s, starts_with({strip_sql('line')}, '```') as fence from md),
m2 as (select *, coalesce(sum(fence::int) over (partition by doc_id order by o rows between unbounded preceding and 1 preceding), 0)::bigint as fences from m1),
m3 as (select *, fences % 2 = 1 and not fence as inside from m2),
m4 as (select *, case when fence or inside or s = '' then null when regexp_matches(s, '^#{{1,6}}[{SP}]+.') then 'H' when regexp_matches(s, '^(?:[-*+]|[0-9]+\\.)[{SP}]+.') then 'L'
  when regexp_matches(s, '^\\|.*\\|') then 'T' when starts_with(s, '|') then 'S' when regexp_matches(s, '^[#*+-]') then 'X' else 'P' end as kind from m3),
m5 as (select *, coalesce(kind in ('T', 'S'), false) as piped from m4),
m6 as (select *, sum((piped and not coalesce(lp, false))::int) over (partition by doc_id order by o rows unbounded preceding) as run from (select *, lag(piped) over (partition by doc_id order by o) as lp from m5)),
m7 as (select *, max((kind = 'T')::int) over (partition by doc_id, piped, run order by o rows unbounded preceding) = 1 as tab from m6),
m8 as (select *, case when kind = 'H' then 'heading' when kind = 'L' then 'list_item' when piped and tab then 'table' when kind is not null then 'paragraph' end as type from m7),
m9 as (select *, case when type in ('heading', 'list_item') then 1 when type = 'table' then (lt is distinct from 'table')::int when type = 'paragraph' then (not (kind = 'P' and lt is not distinct from 'paragraph'))::int else 0 end as st from (select *, lag(type) over (partition by doc_id order by o) as lt from m8)),
m10 as (select *, sum(st) over (partition by doc_id order by o rows unbounded preceding) as blk from m9),
mp as (select doc_id, 'b' || blk as key, o, type, case when kind = 'H' then regexp_replace(s, '^#+[{SP}]+', '') when kind = 'L' then regexp_replace(s, '^(?:[-*+]|[0-9]+\\.)[{SP}]+', '') else s end as part, case when kind = 'H' then length(regexp_extract(s, '^(#+)', 1)) else 0 end as level, true as closing from m10 where type is not null
  union all select doc_id, 'c' || fences, o, 'code', case when inside then line end, 0, fence from m10 where fences % 2 = 1),
mg as (select doc_id, key, type, min(o) as first, max(level)::int as level, coalesce(case when type = 'paragraph' then string_agg(part, ' ' order by o) else string_agg(part, chr(10) order by o) end, '') as text from mp group by doc_id, key, type having bool_or(closing))
select doc_id, (row_number() over (partition by doc_id order by first) - 1)::int as block_ix, type, text, level from mg
"""


@query("a7_markdown_blocks", f"with md as (select doc_id, unnest(l) as line, unnest(range(len(l))) as o from (select doc_id, regexp_split_to_array(text, {_LINE_ENDS}) as l from documents where text is not null)), {_MD}")
def a7_markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A7 and W11 on the texts of the documents."""
    return M.markdown_blocks(M.markdown_lines(table(spark, sf, "documents")))


class _PlainReader:
    """Stands for a recogniser: the bytes are the text, and some cannot be read."""

    def read(self, content: bytes) -> str:
        text = content.decode("utf-8")
        if len(text) % 10 == 0:
            raise ValueError("unreadable")
        return text


@query("a6_recognised_blocks", f"with md as (select doc_id, unnest(l) as line, unnest(range(len(l))) as o from (select doc_id, regexp_split_to_array(text, {_LINE_ENDS}) as l from documents where text is not null and doc_kind = 'pdf_scan' and length(text) % 10 <> 0)), {_MD}")
def a6_recognised_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned files through a recogniser (a stand-in here) to blocks; what it cannot read has none."""
    scans = table(spark, sf, "documents").where("doc_kind = 'pdf_scan' and text is not null").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return M.markdown_blocks(M.markdown_lines(annotators.recognise(scans, _PlainReader())))


_RENDER = f"""
r0 as (select doc_id, pos, case when text is null then ['']
  when type = 'heading' then [repeat('#', greatest(1, least(6, coalesce(level, 1)))) || ' ' || f, '']
  when type = 'list_item' then ['- ' || f, '']
  when type = 'code' then list_concat(['```'], string_split(text, chr(10)), ['```', ''])
  when type = 'table' and starts_with(text, '[[') and try_cast(text as json) is not null then list_concat(list_transform(try_cast(try_cast(text as json) as varchar[][]), lambda c: '| ' || array_to_string(list_transform(c, lambda v: coalesce(v, '')), ' | ') || ' |'), [''])
  when type = 'table' then list_concat(string_split(text, chr(10)), [''])
  else [f, ''] end as l from (select *, {strip_sql(f"regexp_replace(text, '[{SP}]+', ' ', 'g')")} as f from b)),
r1 as (select doc_id, pos, unnest(l) as line, unnest(range(len(l))) as part from r0),
md as (select doc_id || ':' || (pos // 2000) as doc_id, line, pos * 100000 + part as o from r1)
"""


@query("a7_rendered_blocks", f"with {BLOCKS}, {_RENDER}, {_MD}")
def a7_rendered_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks rendered as Markdown (headings, items, fences, tables) and read again, in stretches of 2000 positions.

    Every rendered block ends with a blank line, so a stretch can be read without the one before it, and even a huge
    document spreads over tasks. doc_id names document and stretch.
    """
    lines = M.render_blocks(S.distinct_blocks(table(spark, sf, "block")))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.floor(F.col("pos") / 2000).cast("string"))
    lines = lines.select(key.alias("doc_id"), (F.col("pos").cast("bigint") * 100_000 + F.col("part")).alias("line_no"), "line")
    return M.markdown_blocks(lines, stretch=2000 * 100_000)


# -- sections and plan ----------------------------------------------------------------------------------------------

_CLEAN = f"""
hd as (select distinct doc_id, lower({strip_sql('text')}) as h from b where type = 'heading' and length(lower({strip_sql('text')})) < 80),
cb as (select * from b where type is distinct from 'paragraph' or text is null or not (regexp_matches(lower({strip_sql('text')}), '^(page[{SP}]+[0-9]+|sample file:)') or exists (select 1 from hd where hd.doc_id = b.doc_id and hd.h = lower({strip_sql('b.text')}))))
"""
_SECTIONS = _CLEAN + ", sb as (select *, sum((type = 'heading')::int) over (partition by doc_id order by pos rows unbounded preceding)::bigint as section_ix from cb)"
_VERBS = " + ".join(f"max((type <> 'heading' and contains(lower(coalesce(text, '')), '{v}'))::int)" for v in S.VERBS)
_TYPED = (
    _SECTIONS
    + f""",
sc as (select doc_id, section_ix, case when section_ix = 0 then 'Introduction' else max(text) filter (type = 'heading') end as title, case when section_ix = 0 then 1 else max(level) filter (type = 'heading') end as level,
  arg_min(page, pos) as page_start, count(*) filter (type <> 'heading') as n_blocks, count(*) filter (type = 'table') as n_tables, count(*) filter (type = 'list_item') as n_items, {_VERBS} as verbs from sb group by doc_id, section_ix),
st as (select *, case when n_tables > 0.3 * greatest(n_blocks, 1) then 'reference' when regexp_matches(lower(coalesce(title, '')), '{'|'.join(S.REFERENCE_WORDS)}') then 'reference' when n_items > 0 and verbs >= 2 then 'task'
  when regexp_matches(lower(coalesce(title, '')), '{'|'.join(S.TASK_PHRASES)}') then 'task' else 'concept' end as topic_type from sc)"""
)
_PLANNED = (
    _TYPED
    + """,
p1 as (select *, topic_type = 'concept' as c, coalesce(lag(topic_type = 'concept') over (partition by doc_id order by section_ix), false) as lc from st),
p2 as (select *, sum((not c or not lc)::int) over (partition by doc_id order by section_ix rows unbounded preceding) as run from p1),
p3 as (select *, not c or m is null or level < m as head from (select *, min(level) over (partition by doc_id, run order by section_ix rows between unbounded preceding and 1 preceding) as m from p2)),
pl as (select *, (sum(head::int) over (partition by doc_id order by section_ix rows unbounded preceding) - 1)::bigint as topic_ix from p3)"""
)
_TOPIC_BLOCKS = _PLANNED + ", tb as (select sb.doc_id, topic_ix, topic_type, pos, type, text, page, case when type = 'heading' then 2 else sb.level end as level from sb join pl using (doc_id, section_ix) where type <> 'heading' or not head)"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return S.section_blocks(S.clean_blocks(S.distinct_blocks(table(spark, sf, "block"))))


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    return S.plan_topics(S.topic_type(_sections(spark, sf)))


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return S.sections(S.section_blocks(S.planning_rows(table(spark, sf, "block"))))


def topic_rows(spark: SparkSession, sf: str) -> DataFrame:
    block = table(spark, sf, "block")
    return S.topic_texts(block, *S.place_blocks(block))


@query("c11_clean_blocks", f"with {BLOCKS}, {_CLEAN} select doc_id, pos, type, text from cb")
def c11_clean_blocks(spark, sf):
    """Blocks without echoes of headings and without footers."""
    return S.clean_blocks(S.distinct_blocks(table(spark, sf, "block"))).select("doc_id", "pos", "type", "text")


@query("w7_sections", f"with {BLOCKS}, {_SECTIONS} select doc_id, pos, section_ix from sb")
def w7_sections(spark, sf):
    return _placed(spark, sf).select("doc_id", "pos", F.col("section_ix").cast("bigint").alias("section_ix"))


@query("g4_block_counts", f"with {BLOCKS} select doc_id, " + ", ".join(f"count(*) filter (type = '{t}') as {t}" for t in ("heading", "paragraph", "list_item", "code", "table", "note", "image")) + " from b group by doc_id")
def g4_block_counts(spark, sf):
    kinds = ("heading", "paragraph", "list_item", "code", "table", "note", "image")
    return S.distinct_blocks(table(spark, sf, "block")).groupBy("doc_id").agg(*(F.count_if(F.col("type") == t).alias(t) for t in kinds))


@query("g7_section_types", f"with {BLOCKS}, {_TYPED} select doc_id, section_ix, title, level::int as level, n_blocks, verbs::bigint as verbs, topic_type from st")
def g7_section_types(spark, sf):
    """Sections with their verb hits and rule-based type."""
    t = S.topic_type(_sections(spark, sf))
    return t.select("doc_id", F.col("section_ix").cast("bigint").alias("section_ix"), "title", F.col("level").cast("int").alias("level"), "n_blocks", F.col("verbs").cast("bigint").alias("verbs"), "topic_type")


@query("w8_topic_plan", f"with {BLOCKS}, {_PLANNED} select doc_id, topic_ix, max(title) filter (head) as topic_title, max(topic_type) filter (head) as topic_type, array_to_string(list(section_ix order by section_ix), ',') as sections, case when max(topic_type) filter (head) = 'concept' then 'merged ' || count(*) || ' concept sections' else 'standalone' end as reasoning from pl group by doc_id, topic_ix")
def w8_topic_plan(spark, sf):
    t = S.topics(_planned(spark, sf))
    return t.select("doc_id", F.col("topic_ix").cast("bigint").alias("topic_ix"), "topic_title", "topic_type", F.array_join(F.transform("section_indices", lambda i: i.cast("string")), ",").alias("sections"), "reasoning")


@query("flagship_topics", f"with {BLOCKS}, {_PLANNED} select topic_type, count(*) filter (head) as topics, count(*) as sections, sum(n_blocks)::bigint as blocks from pl group by topic_type")
def flagship_topics(spark, sf):
    """From block rows to topics by type."""
    p = _planned(spark, sf)
    return p.groupBy("topic_type").agg(F.count_if("_head").alias("topics"), F.count("*").alias("sections"), F.sum("n_blocks").cast("bigint").alias("blocks"))


@query("j7_topic_blocks", f"with {BLOCKS}, {_TOPIC_BLOCKS} select doc_id, topic_ix, pos, type, level::int as level from tb")
def j7_topic_blocks(spark, sf):
    """Blocks bound to topics."""
    rows = S.topic_blocks(*S.place_blocks(table(spark, sf, "block")))
    return rows.select("doc_id", F.col("topic_ix").cast("bigint").alias("topic_ix"), "pos", "type", F.col("level").cast("int").alias("level"))


@query("j7_planned_sections", "select distinct doc_id, topic_ix, topic_title, k::int as k, section_ix from (select doc_id, topic_ix, topic_title, unnest(section_indices) as section_ix, unnest(range(len(section_indices))) as k from topic_plan)")
def j7_planned_sections(spark, sf):
    """Stored plans by section."""
    return table(spark, sf, "topic_plan").select("doc_id", "topic_ix", "topic_title", F.posexplode("section_indices").alias("k", "section_ix")).distinct()


@query("c13_empty_topics", f"with {BLOCKS}, {_PLANNED} select doc_id, count(*) as topics, count(*) filter (n = 0 and s = 1) as skipped from (select doc_id, topic_ix, sum(n_blocks) as n, count(*) as s from pl group by doc_id, topic_ix) group by doc_id")
def c13_empty_topics(spark, sf):
    return S.empty_topics(_planned(spark, sf))


@query("l1_previews", f"with {BLOCKS}, {_SECTIONS}, pv as (select doc_id, section_ix, text, row_number() over (partition by doc_id, section_ix order by pos) as n from sb where type <> 'heading') select doc_id, section_ix, substring(string_agg(substring(coalesce(text, ''), 1, 100), ' ' order by n), 1, 200) as preview from pv where n <= 3 group by doc_id, section_ix")
def l1_previews(spark, sf):
    p = S.previews(_placed(spark, sf))
    return p.select("doc_id", F.col("section_ix").cast("bigint").alias("section_ix"), "preview")


@query("c14_block_prompts", f"with {BLOCKS}, {_TOPIC_BLOCKS} select doc_id, topic_ix, string_agg(case when type = 'heading' then '[SUBSECTION_TITLE level=' || level || '] ' when type = 'table' then '[TABLE]' || chr(10) when type = 'code' then '[CODE]' || chr(10) when type = 'image' then '[IMAGE] filename: ' when type = 'list_item' then '[LIST_ITEM] ' when type = 'note' then '[NOTE] ' else '[PARAGRAPH] ' end || coalesce(text, '') || chr(10), '' order by pos) as prompt from tb group by doc_id, topic_ix")
def c14_block_prompts(spark, sf):
    """C14: the blocks of each topic as tagged lines."""
    return S.prompts(topic_rows(spark, sf)).select("doc_id", F.col("topic_ix").cast("bigint").alias("topic_ix"), "prompt")


_OTHERS = "list_filter(l, lambda o: o.title <> ph.title)"
_HEADS = f"""ph0 as (select doc_id, topic_ix, max(title) filter (head) as title, max(topic_type) filter (head) as topic_type from pl group by doc_id, topic_ix),
pt as (select doc_id, max(title) as document, max(case when doc_id % 3 = 0 then upper(source) end) as product from documents group by doc_id),
ph as (select ph0.*, document, product, {name_sql("title", "topic_type")} as filename from ph0 left join pt using (doc_id)),
pg as (select doc_id, list({{'topic_ix': topic_ix, 'title': title, 'filename': filename}} order by topic_ix) as l from ph group by doc_id),
hd2 as (select ph.doc_id, topic_ix, case when coalesce(document, '') <> '' then 'Document: ' || document || chr(10) else '' end || case when coalesce(title, '') <> '' then 'Topic: ' || title || chr(10) else '' end
 || case when coalesce(product, '') <> '' then 'Product: ' || product || chr(10) else '' end
 || case when len({_OTHERS}) > 0 then 'Other topics: ' || array_to_string(list_transform({_OTHERS}, lambda o: o.title), ', ') || chr(10)
 || 'Files of other topics:' || chr(10) || array_to_string(list_transform({_OTHERS}, lambda o: '  ' || o.title || ' = ' || o.filename || chr(10)), '') else '' end || chr(10) || 'Blocks:' || chr(10) as head from ph join pg using (doc_id)),
pb as (select doc_id, topic_ix, string_agg(case when type = 'heading' then '[SUBSECTION_TITLE level=' || level || '] ' when type = 'table' then '[TABLE]' || chr(10) when type = 'code' then '[CODE]' || chr(10)
 when type = 'image' then '[IMAGE] filename: ' when type = 'list_item' then '[LIST_ITEM] ' when type = 'note' then '[NOTE] ' else '[PARAGRAPH] ' end || coalesce(text, '') || chr(10), '' order by pos) as prompt from tb group by doc_id, topic_ix)"""


@query("c14_prompts", f"with {BLOCKS}, {_TOPIC_BLOCKS}, {_HEADS} select doc_id, topic_ix, head || prompt as prompt from pb join hd2 using (doc_id, topic_ix)")
def c14_prompts(spark, sf):
    """C14: whole prompts, with titles, products (of every third document, named by its source) and the files of other topics."""
    block = table(spark, sf, "block")
    rows, planned = S.place_blocks(block)
    titles = S.topics(planned).select("doc_id", "topic_ix", F.col("topic_title").alias("title"), "topic_type")
    docs = table(spark, sf, "documents").groupBy("doc_id").agg(F.max("title").alias("document"), F.max(F.when(F.col("doc_id") % 3 == 0, F.upper("source"))).alias("product"))
    heads = titles.join(docs, "doc_id", "left").withColumn("filename", T.topic_filename(F.col("title"), F.col("topic_type")))
    return S.prompts(S.topic_texts(block, rows, planned), heads).select("doc_id", F.col("topic_ix").cast("bigint").alias("topic_ix"), "prompt")


@query("j10_other_titles", "with t as (select distinct doc_id, topic_ix, topic_title from topic_plan), g as (select doc_id, list(topic_title order by topic_ix) as l from t group by doc_id) select doc_id, topic_ix, array_to_string(list_filter(l, lambda x: x <> topic_title), ', ') as others from t join g using (doc_id)")
def j10_other_titles(spark, sf):
    """The other titles of the same document; a document has few topics."""
    t = table(spark, sf, "topic_plan").select("doc_id", "topic_ix", "topic_title").distinct()
    g = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("topic_ix", "topic_title"))).alias("l"))
    return t.join(g, "doc_id").select("doc_id", "topic_ix", F.array_join(F.array_remove(F.transform("l", lambda x: x["topic_title"]), F.col("topic_title")), ", ").alias("others"))


@query("l3_products", f"with {BLOCKS}, n as (select doc_id, pos, nullif(regexp_extract('Use ABC''s ' || text, '(?:^|[^{WD}])([A-Z]{{2,}})''s[{SP}]+', 1), '') as p from b where type in ('paragraph', 'list_item')) select doc_id, arg_min(p, pos) as product from n where p is not null group by doc_id")
def l3_products(spark, sf):
    """The first product name of each document (a possessive is put before every text, as the data have none)."""
    b = S.distinct_blocks(table(spark, sf, "block"))
    return S.products(b.withColumn("text", F.concat(F.lit("Use ABC's "), "text")))


# -- tables ---------------------------------------------------------------------------------------------------------

_GRID = f"""case when starts_with(text, '[') then try_cast(try_cast(text as json) as varchar[][]) else
 list_transform(list_filter(string_split(text, chr(10)), lambda r: contains(r, '|') and not regexp_matches(r, '^[|\\s:-]*$')), lambda r: list_transform(string_split(regexp_replace({strip_sql('r')}, '^\\||\\|$', '', 'g'), '|'), lambda c: {strip_sql('c')})) end"""


@query("a4_table_cells", f"with {BLOCKS}, g as (select doc_id, pos, {_GRID} as g from b where type = 'table'), r as (select doc_id, pos, unnest(g) as row, unnest(range(1, len(g) + 1)) as r from g) select doc_id, pos, r::int as r, array_to_string(list_transform(row, lambda c: {strip_sql('''replace(coalesce(c, ''), chr(10), ' ')''')}), '|') as cells from r")
def a4_table_cells(spark, sf):
    """Rows of both kinds of table, cells cleaned."""
    b = S.distinct_blocks(table(spark, sf, "block")).where("type = 'table'")
    return b.select("doc_id", "pos", F.posexplode(E.clean_grid(E.table_grid(F.col("text")))).alias("r", "cells")).select("doc_id", "pos", (F.col("r") + 1).alias("r"), F.array_join("cells", "|").alias("cells"))


# -- bodies, files, maps --------------------------------------------------------------------------------------------

_C15 = f"""x as (select *, type = 'heading' and level >= 2 as opens from tb where topic_type = 'concept'), y as (select *, sum(opens::int) over (partition by doc_id, topic_ix order by pos rows unbounded preceding) as n from x),
z as (select doc_id, topic_ix, pos, n, {esc_sql("coalesce(text, '')")} as t, * exclude (doc_id, topic_ix, pos, n) from y),
l as (select doc_id, topic_ix, pos, n, case when opens then case when n > 1 then '</section>' || chr(10) else '' end || '<section class="- topic/section ">' || chr(10) || '<title class="- topic/title ">' || t || '</title>'
 when type = 'paragraph' then '<p class="- topic/p ">' || t || '</p>' when type = 'note' then '<note class="- topic/note ">' || t || '</note>'
 when type = 'image' then '<fig class="- topic/fig "><title class="- topic/title ">Figure</title><image href="' || coalesce(text, '') || '" class="- topic/image "/></fig>'
 when type = 'code' then '<codeblock class="+ topic/pre pr-d/codeblock ">' || t || '</codeblock>' end as line from z)
select doc_id, topic_ix, '<conbody class="- topic/body  concept/conbody ">' || chr(10) || coalesce(string_agg(line, chr(10) order by pos) || chr(10), '') || case when max(n) > 0 then '</section>' || chr(10) else '' end || '</conbody>' as body_xml from l group by doc_id, topic_ix"""


def _body(spark, sf, kind, f):
    return f(topic_rows(spark, sf).where(F.col("topic_type") == kind)).select("doc_id", F.col("topic_ix").cast("bigint").alias("topic_ix"), "body_xml")


@query("c15_concept_bodies", f"with {BLOCKS}, {_TOPIC_BLOCKS}, {_C15}")
def c15_concept_bodies(spark, sf):
    """C15 and W10."""
    return _body(spark, sf, "concept", E.concept_bodies)


_C16 = f"""x as (select *, sum((type = 'list_item')::int) over (partition by doc_id, topic_ix order by pos rows unbounded preceding) as step from tb where topic_type = 'task'),
y as (select *, case when step = 0 then 0 when type in ('list_item', 'code') then 1 else 2 end as part, {esc_sql("coalesce(text, '')")} as t, {esc_sql(strip_sql(f"regexp_replace(coalesce(text, ''), '^[0-9]+\\.[{SP}]*', '')"))} as c from x),
s1 as (select doc_id, topic_ix, step, string_agg(case when type = 'list_item' then '<cmd class="- topic/ph task/cmd ">' || c || '</cmd>' else '<stepxmp class="- topic/itemgroup task/stepxmp "><codeblock class="+ topic/pre pr-d/codeblock ">' || t || '</codeblock></stepxmp>' end, chr(10) order by pos) as s from y where part = 1 group by all),
s2 as (select doc_id, topic_ix, 1 as part, '<steps class="- topic/ol task/steps ">' || chr(10) || string_agg('<step class="- topic/li task/step ">' || chr(10) || s || chr(10) || '</step>', chr(10) order by step) || chr(10) || '</steps>' as w from s1 group by doc_id, topic_ix),
s3 as (select doc_id, topic_ix, part, case when part = 0 then '<context class="- topic/section task/context ">' else '<result class="- topic/section task/result ">' end || chr(10) || string_agg('<p class="- topic/p ">' || t || '</p>', chr(10) order by pos) || chr(10) || case when part = 0 then '</context>' else '</result>' end as w from y where part <> 1 group by doc_id, topic_ix, part)
select doc_id, topic_ix, '<taskbody class="- topic/body task/taskbody ">' || chr(10) || string_agg(w, chr(10) order by part) || chr(10) || '</taskbody>' as body_xml from (select * from s2 union all select * from s3) group by doc_id, topic_ix"""


@query("c16_task_bodies", f"with {BLOCKS}, {_TOPIC_BLOCKS}, {_C16}")
def c16_task_bodies(spark, sf):
    """C16 and W9."""
    return _body(spark, sf, "task", E.task_bodies)


_ROW = f"""'<row class="- topic/row ">' || array_to_string(list_transform({{r}}, lambda c: '<entry class="- topic/entry ">' || {esc_sql("coalesce(c, '')")} || '</entry>'), '') || '</row>'"""
_C17 = f"""x as (select *, case when type = 'table' then {_GRID} end as g from tb where topic_type = 'reference'),
l as (select doc_id, topic_ix, pos, case when type = 'table' and len(g) > 0 and len(g[1]) > 0 then '<table class="- topic/table "><tgroup cols="' || len(g[1]) || '" class="- topic/tgroup ">' || array_to_string(list_transform(range(1, len(g[1]) + 1), lambda i: '<colspec colname="c' || i || '" colnum="' || i || '" class="- topic/colspec "/>'), '')
 || '<thead class="- topic/thead ">' || {_ROW.format(r='g[1]')} || '</thead><tbody class="- topic/tbody ">' || array_to_string(list_transform(g[2:], lambda r: {_ROW.format(r='r')}), '') || '</tbody></tgroup></table>'
 when type = 'paragraph' then '<p class="- topic/p ">' || {esc_sql("coalesce(text, '')")} || '</p>' end as line from x)
select doc_id, topic_ix, '<refbody class="- topic/body        reference/refbody ">' || chr(10) || '<section class="- topic/section ">' || chr(10) || coalesce(string_agg(line, chr(10) order by pos) || chr(10), '') || '</section>' || chr(10) || '</refbody>' as body_xml from l group by doc_id, topic_ix"""


@query("c17_reference_bodies", f"with {BLOCKS}, {_TOPIC_BLOCKS}, {_C17}")
def c17_reference_bodies(spark, sf):
    return _body(spark, sf, "reference", E.reference_bodies)


_ROOT = " ".join(f"when '{t}' then '<{t} id=\"{t}-' || i || '\" xml:lang=\"en-us\" class=\"{c}\">'" for t, c in E.ROOT_CLASSES.items() if t != "concept")
_NORM = f"list_slice(list_transform(list_filter(keywords, lambda k: {strip_sql('''coalesce(k, '')''')} <> ''), lambda k: substring(lower({strip_sql('k')}), 1, 40)), 1, 7)"
_FILES = f"""ft as (select distinct doc_id, topic_ix, title, topic_type, body_xml, shortdesc, keywords from topic),
f0 as (select *, substring(sha256(doc_id || chr(31) || coalesce(title, '')), 1, 8) as i, {strip_sql("coalesce(shortdesc, '')")} as sd, {_NORM} as kw, case when topic_type in ('task', 'reference') then topic_type else 'concept' end as tt from ft),
files as (select doc_id, topic_ix, {name_sql("coalesce(title, '')", 'topic_type')} as filename, title, topic_type, concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8"?>',
 '<!DOCTYPE ' || tt || ' PUBLIC "-//OASIS//DTD DITA ' || upper(substring(tt, 1, 1)) || substring(tt, 2) || '//EN" "' || tt || '.dtd">',
 case tt {_ROOT} else '<concept id="concept-' || i || '" xml:lang="en-us" class="{E.ROOT_CLASSES['concept']}">' end,
 '<title class="- topic/title ">' || {xesc_sql("coalesce(title, '')")} || '</title>', case when sd <> '' then '<shortdesc class="- topic/shortdesc ">' || {xesc_sql('sd')} || '</shortdesc>' end,
 case when len(kw) > 0 then '<prolog class="- topic/prolog "><metadata class="- topic/metadata "><keywords class="- topic/keywords ">' || array_to_string(list_transform(kw, lambda k: '<keyword class="- topic/keyword ">' || {xesc_sql('k')} || '</keyword>'), '') || '</keywords></metadata></prolog>' end,
 coalesce(body_xml, ''), '</' || tt || '>') as xml from f0)"""


def topic_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topic").select("doc_id", "topic_ix", "title", "topic_type", "body_xml", "shortdesc", "keywords").distinct()


def files(spark: SparkSession, sf: str) -> DataFrame:
    return E.topic_files(topic_table(spark, sf))


@query("c18_topic_files", f"with {_FILES} select *, count(*) over (partition by doc_id, filename) > 1 as clash from files")
def c18_topic_files(spark, sf):
    """Whole topic files with stable ids."""
    return files(spark, sf)


_FIRST_WORD = _FILES.replace("ft as (select distinct doc_id, topic_ix, title, topic_type,", "ft as (select distinct doc_id, topic_ix, string_split(title, ' ')[1] as title, 'task' as topic_type,")


@query("b1_file_clashes", f"with {_FIRST_WORD} select doc_id, filename, count(*) as n, min(topic_ix)::int as first from files group by all having count(*) > 1")
def b1_file_clashes(spark, sf):
    """B1: topics of a document that would be written under one name; titles are cut to their first word, so that there are some."""
    t = topic_table(spark, sf).select("doc_id", "topic_ix", F.substring_index("title", " ", 1).alias("title"), F.lit("task").alias("topic_type"), "body_xml", "shortdesc", "keywords")
    f = E.topic_files(t.distinct()).where("clash")
    return f.groupBy("doc_id", "filename").agg(F.count("*").alias("n"), F.min("topic_ix").alias("first"))


_MAPS = f"""of as (select distinct doc_id, topic_ix, filename from out_file),
refs as (select doc_id, string_agg('<topicref href="' || filename || '" class="- map/topicref "/>', chr(10) order by topic_ix, filename) as refs from of group by doc_id),
mt as (select doc_id, max(title) as title, max(case when doc_id % 2 = 0 then upper(source) end) as product from documents group by doc_id),
maps as (select doc_id, 'm_' || {slug_sql("coalesce(title, '')")} || '.ditamap' as filename, concat_ws(chr(10),
 '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE map PUBLIC "-//OASIS//DTD DITA Map//EN" "map.dtd">', '<map id="ditamap-' || substring(sha256(doc_id::varchar), 1, 8) || '" class="- map/map ">',
 '<title class="- topic/title ">' || {xesc_sql("coalesce(title, '')")} || '</title>', refs,
 '<keydef keys="product-name" class="+ map/topicref mapgroup-d/keydef ">' || chr(10) || '<topicmeta class="- map/topicmeta ">' || chr(10) || '<keywords class="- topic/keywords ">' || chr(10)
 || '<keyword class="- topic/keyword ">' || {xesc_sql("product")} || '</keyword>' || chr(10) || '</keywords>' || chr(10) || '</topicmeta>' || chr(10) || '</keydef>', '</map>') as xml from refs left join mt using (doc_id))"""


@query("b2_maps", f"with {_MAPS} select * from maps")
def b2_maps(spark, sf):
    """B2: maps; the documents with even ids have a product, named by their source."""
    f = table(spark, sf, "out_file").select("doc_id", "topic_ix", "filename").distinct()
    named = table(spark, sf, "documents").groupBy("doc_id").agg(F.max("title").alias("title"), F.max(F.when(F.col("doc_id") % 2 == 0, F.upper("source"))).alias("product"))
    return E.maps(f, named.select("doc_id", "title"), named.where("product is not null").select("doc_id", "product"))


#: File names under the prefix of another type: c, t and r go round.
_STALE_SQL = "case substring(filename, 1, 2) when 'c_' then 't_' when 't_' then 'r_' else 'c_' end || substring(filename, 3)"


def _stale(name) -> F.Column:
    return F.concat(F.translate(F.substring(name, 1, 1), "ctr", "trc"), F.expr("substring(filename, 2)"))


_HREFS = f"hr as (select distinct doc_id, case topic_ix % 4 when 0 then filename when 1 then {_STALE_SQL} when 2 then 'http://site/' || filename else 'c_nowhere.dita' end as href from out_file)"


@query("j8_links", f"with {_HREFS}, fl as (select distinct doc_id, filename from out_file), lo as (select doc_id, regexp_replace(filename, '^[ctr]_', '') as bare, min(filename) as other from fl group by all) select hr.doc_id, href, case when contains(href, '/') or starts_with(href, 'http') or fl.filename is not null or other is null then href else other end as target from hr left join fl on fl.doc_id = hr.doc_id and fl.filename = href left join lo on lo.doc_id = hr.doc_id and lo.bare = regexp_replace(href, '^[ctr]_', '')")
def j8_links(spark, sf):
    """Links to every file, some with a stale prefix, some outside."""
    of = table(spark, sf, "out_file")
    href = F.when(F.col("topic_ix") % 4 == 0, F.col("filename")).when(F.col("topic_ix") % 4 == 1, _stale("filename")).when(F.col("topic_ix") % 4 == 2, F.concat(F.lit("http://site/"), "filename")).otherwise("c_nowhere.dita")
    return E.resolve_links(of.select("doc_id", href.alias("href")).distinct(), of.select("doc_id", "filename").distinct())


_LINKED = f"""{_FILES.replace("coalesce(body_xml, ''),", "coalesce(body_xml, ''), '#LINKS#',")},
fn as (select doc_id, topic_ix, filename, title, topic_type, xml, {_STALE_SQL} as stale from files),
ex as (select distinct doc_id, filename from fn), lo as (select doc_id, regexp_replace(filename, '^[ctr]_', '') as bare, min(filename) as other from ex group by all)
select fn.doc_id, topic_ix, fn.filename, replace(xml, '#LINKS#', '<p><xref class="a" href="' || case when ex.filename is not null then stale else other end || '">x</xref><xref href="http://site/' || stale || '"/><xref href="c_nowhere.dita"/></p>') as xml
from fn left join ex on ex.doc_id = fn.doc_id and ex.filename = stale left join lo on lo.doc_id = fn.doc_id and lo.bare = regexp_replace(stale, '^[ctr]_', '')"""


@query("j8_written_links", f"with {_LINKED}")
def j8_written_links(spark, sf):
    """Emitted files whose links were made for another topic type, led to the files that exist."""
    name = T.topic_filename(F.coalesce("title", F.lit("")), F.col("topic_type"))
    links = F.concat(F.lit('\n<p><xref class="a" href="'), "stale", F.lit('">x</xref><xref href="http://site/'), "stale", F.lit('"/><xref href="c_nowhere.dita"/></p>'))
    t = topic_table(spark, sf).withColumn("filename", name).withColumn("stale", _stale("filename"))
    f = E.topic_files(t.withColumn("body_xml", F.concat(F.coalesce("body_xml", F.lit("")), links)))
    return E.write_references(f.select("doc_id", "topic_ix", "filename", "xml"))


_IMAGES = "im as (select distinct doc_id, meta.filename as filename from block where type = 'image' and meta.filename is not null)"


@query("j9_images", f"with {_IMAGES}, rf as (select distinct doc_id, regexp_replace(filename, '\\.[^.]*$', '') || '.gif' as href from im), al as (select doc_id, regexp_replace(filename, '\\.[^.]*$', '') as stem, arg_min(filename, (list_position(['.jpg', '.jpeg', '.png', '.gif'], regexp_extract(filename, '(\\.[^.]*)$', 1)), filename)) as other from im where list_position(['.jpg', '.jpeg', '.png', '.gif'], regexp_extract(filename, '(\\.[^.]*)$', 1)) > 0 group by all) select rf.doc_id, href, coalesce(im.filename, other, href) as target from rf left join im on im.doc_id = rf.doc_id and im.filename = href left join al on al.doc_id = rf.doc_id and al.stem = regexp_replace(href, '\\.[^.]*$', '')")
def j9_images(spark, sf):
    """Image references with a wrong ending."""
    im = table(spark, sf, "block").where("type = 'image' and meta.filename is not null").select("doc_id", F.col("meta.filename").alias("filename")).distinct()
    return E.resolve_images(im.select("doc_id", F.concat(F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit(".gif")).alias("href")).distinct(), im)


_KIDS = "kd as (select doc_id, topic_ix, body_xml, regexp_extract_all(body_xml, '<([A-Za-z][A-Za-z0-9-]*)', 1) as k from (select distinct doc_id, topic_ix, body_xml from topic where body_xml is not null))"


def _order_sql(order: tuple[str, ...], last: bool) -> str:
    known = "[" + ", ".join(f"'{t}'" for t in order) + "]"
    rank = f"case when coalesce(list_position({known}, k[i]), 0) > 0 then {'1' if last else f'list_position({known}, k[i])'} else {'0' if last else '99'} end"
    return f"array_to_string(list_transform(list_sort(list_transform(range(1, len(k) + 1), lambda i: {{'r': {rank}, 'i': i, 't': k[i]}})), lambda s: s.t), ' ')"


@query("s4_conbody_order", f"with {_KIDS} select doc_id, topic_ix, md5(body_xml) as m, {_order_sql(E.LAST_IN_CONBODY, True)} as tags from kd")
def s4_conbody_order(spark, sf):
    """A stable partition of elements, sections last."""
    return _ordered_tags(spark, sf, E.LAST_IN_CONBODY, True)


@query("s5_taskbody_order", f"with {_KIDS} select doc_id, topic_ix, md5(body_xml) as m, {_order_sql(E.TASKBODY_ORDER, False)} as tags from kd")
def s5_taskbody_order(spark, sf):
    return _ordered_tags(spark, sf, E.TASKBODY_ORDER, False)


def _ordered_tags(spark, sf, order, last):
    t = table(spark, sf, "topic").where("body_xml is not null").select("doc_id", "topic_ix", "body_xml").distinct()
    kids = F.transform(F.regexp_extract_all("body_xml", F.lit("<([A-Za-z][A-Za-z0-9-]*)"), 1), lambda x, i: F.struct(i.alias("ix"), x.alias("tag")))
    return t.select("doc_id", "topic_ix", F.md5("body_xml").alias("m"), F.array_join(E.child_order(kids, order, last), " ").alias("tags"))


@query("u8_abbreviations", f"with {BLOCKS} select doc_id, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(text, '\\b(via|i\\.e\\.|e\\.g\\.|etc\\.|cf\\.|approx\\.)'))))), ',') as found from b where regexp_matches(text, '\\b(via|i\\.e\\.|e\\.g\\.|etc\\.|cf\\.|approx\\.)') group by doc_id")
def u8_abbreviations(spark, sf):
    """U8: distinct Latin abbreviations by document; the set of words is small and fixed."""
    b = S.distinct_blocks(table(spark, sf, "block"))
    hits = b.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(via|i\.e\.|e\.g\.|etc\.|cf\.|approx\.)"), 1)).alias("w")).distinct()
    return hits.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("found"))


@query("j11_cache_hits", "with t as (select distinct doc_id, topic_ix, substring(sha256(coalesce(title, '') || chr(31) || coalesce(body_xml, '')), 1, 16) as key from topic), c as (select distinct key from t where topic_ix = 0) select doc_id, topic_ix, key, c.key is not null as hit from t left join c using (key)".replace("c.key is not null", "key in (select key from c)").replace(" from t left join c using (key)", " from t"))
def j11_cache_hits(spark, sf):
    """Keys of all topics against a cache that holds those of first topics."""
    t = table(spark, sf, "topic").select("doc_id", "topic_ix", T.cache_key(F.coalesce("title", F.lit("")), F.coalesce("body_xml", F.lit(""))).alias("key")).distinct()
    cache = t.where("topic_ix = 0").select(F.col("key").alias("_k")).distinct()
    return t.join(cache, F.col("key") == F.col("_k"), "left").select("doc_id", "topic_ix", "key", F.col("_k").isNotNull().alias("hit"))
