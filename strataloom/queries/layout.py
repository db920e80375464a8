"""Queries of the layout operators, on words laid out from the documents by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import MONO_MARKS
from strataloom.operators import layout as L
from strataloom.plans.tables import table
from strataloom.queries.registry import SP, WD, query, strip_sql

LINES_A_PAGE = 40
#: Every so many lines, one is a note; of ten documents, one has a cover and one a page of contents.
NOTE_EVERY, COVER, CONTENTS = 29, 4, 3

_MONO = "|".join(MONO_MARKS)

#: The same layout in SQL: every line of a text is a line of words, 40 lines a page; the fonts reach every rule.
WORDS = f"""
d0 as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10)))))::int as line_no from documents where text is not null),
d as (select doc_id, line_no, case when line_no % {NOTE_EVERY} = 7 then 'Note: ' || line else line end as line from d0),
w0 as (select doc_id, line_no, unnest(string_split(line, ' ')) as text, unnest(range(len(string_split(line, ' ')))) as k,
       unnest(list_prepend(0, list_transform(range(1, len(string_split(line, ' '))), lambda i: (len(array_to_string(list_slice(string_split(line, ' '), 1, i), ' ')) + 1)))) as x,
       starts_with(line, 'Note:') as noted from d),
words as (select doc_id, (line_no // {LINES_A_PAGE} + 1)::int as page, ((line_no % {LINES_A_PAGE}) * 10000 + k)::int as word_ix, text, (7 * x)::double as x0, (7 * (x + len(text)))::double as x1,
       (case when line_no % {LINES_A_PAGE} = 0 then 40 else 60 end + 14 * (line_no % {LINES_A_PAGE}) + case when line_no % 5 = 0 then 10 else 0 end)::double as top,
       (case when line_no = 0 then case doc_id % 10 when {COVER} then 36 else 18 end when noted then 10 when line_no % 12 = 0 then 14 when line_no % 17 = 0 then 9 when line_no % 23 = 0 then 8 else 10 end)::double as size,
       case when line_no = 0 or noted or line_no % 12 = 0 then 'Garamond-Bold' when line_no % 17 = 0 then 'CourierNew' else 'Garamond' end as fontname from w0 where text <> ''),
wb as (select *, top + size as bottom from words)
"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines placed by page before they grow into words; all windows and joins on pages below keep this placement."""
    texts = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.when(F.col("line_no") % NOTE_EVERY == 7, F.concat(F.lit("Note: "), "line")).otherwise(F.col("line")))
    return lines.withColumn("page", (F.floor(F.col("line_no") / LINES_A_PAGE) + 1).cast("int")).repartition("doc_id", "page")


def words(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    starts = F.expr("transform(split(line, ' ', -1), (p, i) -> named_struct('t', p, 'x', if(i = 0, 0, length(substring_index(line, ' ', i)) + 1)))")
    ws = lines.select("doc_id", "page", "line_no", F.startswith("line", F.lit("Note:")).alias("noted"), F.posexplode(starts).alias("k", "z")).select("doc_id", "page", "line_no", "noted", "k", F.col("z.t").alias("text"), F.col("z.x").alias("x")).where("text <> ''")
    row = F.col("line_no") % LINES_A_PAGE
    size = F.when((F.col("line_no") == 0) & (F.col("doc_id") % 10 == COVER), 36).when(F.col("line_no") == 0, 18).when(F.col("noted"), 10).when(F.col("line_no") % 12 == 0, 14).when(F.col("line_no") % 17 == 0, 9).when(F.col("line_no") % 23 == 0, 8).otherwise(10).cast("double")
    top = (F.when(row == 0, 40).otherwise(60) + 14 * row + F.when(F.col("line_no") % 5 == 0, 10).otherwise(0)).cast("double")
    font = F.when((F.col("line_no") == 0) | F.col("noted") | (F.col("line_no") % 12 == 0), "Garamond-Bold").when(F.col("line_no") % 17 == 0, "CourierNew").otherwise("Garamond")
    return ws.select("doc_id", "page", (row * 10000 + F.col("k")).cast("int").alias("word_ix"), "text", (7.0 * F.col("x")).alias("x0"), (7.0 * (F.col("x") + F.length("text"))).alias("x1"), top.alias("top"), (top + size).alias("bottom"), font.alias("fontname"), size.alias("size"))


BOXES = f"boxes as (select distinct doc_id, page, 0.0::double as x0, {60 + 14 * 10}.0::double as top, 5000.0::double as x1, {60 + 14 * 12 + 30}.0::double as bottom from words where page % 3 = 0)"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One table on every third page, over its lines 10 to 12."""
    return _lines(spark, sf).where("page % 3 = 0").select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(60.0 + 14 * 10).alias("top"), F.lit(5000.0).alias("x1"), F.lit(60.0 + 14 * 12 + 30).alias("bottom")).distinct()


PAGES = f"pages as (select doc_id, (line_no // {LINES_A_PAGE} + 1)::int as page, case when doc_id % 10 = {CONTENTS} and line_no // {LINES_A_PAGE} = 1 then 'TABLE of Contents' || chr(10) else '' end || string_agg(line, chr(10) order by line_no) as text from d group by doc_id, line_no // {LINES_A_PAGE})"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    g = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("p"))
    head = F.when((F.col("doc_id") % 10 == CONTENTS) & (F.col("page") == 2), "TABLE of Contents\n").otherwise("")
    return g.select("doc_id", "page", F.concat(head, F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("text"))


@query("a3_page_text", f"with {WORDS}, {PAGES} select * from pages")
def a3_page_text(spark, sf):
    return pages(spark, sf)


@query("c1_monospace", f"with {WORDS} select fontname, regexp_matches(lower(fontname), '{_MONO}') as mono, contains(lower(fontname), 'bold') as bold, count(*) as n from words group by all")
def c1_monospace(spark, sf):
    """Words by font, with both font predicates."""
    return words(spark, sf).groupBy("fontname", L.is_monospace(F.col("fontname")).alias("mono"), L.is_bold(F.col("fontname")).alias("bold")).agg(F.count("*").alias("n"))


@query("c5_contents_pages", f"with {WORDS}, {PAGES} select distinct doc_id, page from pages where contains(lower(text), 'table of contents')")
def c5_contents_pages(spark, sf):
    return L.contents_pages(pages(spark, sf))


@query("c6_cover_pages", f"with {WORDS} select doc_id, page from words group by all having max(size) > 30 and count(*) < 40")
def c6_cover_pages(spark, sf):
    return L.cover_pages(words(spark, sf))


_SCANNED = f"with {WORDS}, {PAGES} select doc_id from pages group by doc_id having sum(case when page <= 3 then length({strip_sql('text')}) else 0 end) < 80"


@query("c7_scanned_documents", _SCANNED)
def c7_scanned_documents(spark, sf):
    return L.scanned_documents(pages(spark, sf))


_INSIDE = "b.doc_id = w.doc_id and b.page = w.page and w.x0 >= b.x0 - 2 and w.top >= b.top - 2 and w.x1 <= b.x1 + 2 and w.bottom <= b.bottom + 2"


@query("c8_words_outside_tables", f"with {WORDS}, {BOXES} select doc_id, page, count(*) as n from wb w where not exists (select 1 from boxes b where {_INSIDE}) group by all")
def c8_words_outside_tables(spark, sf):
    """Words of each page that no table box holds."""
    w = words(spark, sf)
    return L.words_outside_tables(w, boxes(spark, sf)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


_LEVELS = "lv as (select doc_id, size, count(*) as n, dense_rank() over (partition by doc_id order by size desc)::int as level from words where contains(lower(fontname), 'bold') and size > 12 group by doc_id, size)"


@query("g1_heading_levels", f"with {WORDS}, {_LEVELS} select * from lv")
def g1_heading_levels(spark, sf):
    """Bold sizes with counts, ranked."""
    return L.heading_levels(words(spark, sf))


_BODY = "body as (select doc_id, page, arg_max(size, (n, -first)) as body from (select doc_id, page, size, sum(length(text)) as n, min(word_ix) as first from wk group by all) group by all)"


@query("g2_body_size", f"with {WORDS}, {_BODY.replace('from wk', 'from words')} select * from body")
def g2_body_size(spark, sf):
    return L.body_sizes(words(spark, sf))


_KEEP = "wk as (select w.* from wb w where (w.doc_id, w.page) not in (select doc_id, page from pages where contains(lower(text), 'table of contents')) and (w.doc_id, w.page) not in (select doc_id, page from words group by all having max(size) > 30 and count(*) < 40))"
_PLACED = """lw as (select *, sum(jump) over (partition by doc_id, page order by round(top, 1), x0, word_ix rows unbounded preceding) as line_ix from
 (select *, case when abs(top - lag(top) over (partition by doc_id, page order by round(top, 1), x0, word_ix)) >= 4 then 1 else 0 end as jump from wk))"""
_LINES = f"""fl as (select doc_id, page, line_ix, arg_max(f, (n, -first)) as f from (select doc_id, page, line_ix, {{'font': fontname, 'size': size}} as f, sum(length(text)) as n, min(word_ix) as first from lo group by all) group by all),
ln as (select doc_id, page, line_ix, regexp_replace(regexp_replace({strip_sql("string_agg(text, ' ' order by round(top, 1), x0, word_ix)")}, '([{WD}])[{SP}]+[‑-][{SP}]+([{WD}])', '\\1-\\2', 'g'), '([{WD}])[{SP}]+[‑-][{SP}]+([{WD}])', '\\1-\\2', 'g') as text,
 arg_min(top, (round(top, 1), x0, word_ix)) as top, max(bottom) as bottom from lo group by all),
li as (select ln.*, f.font as fontname, f.size as size from ln join fl using (doc_id, page, line_ix))"""


@query("w1_lines", f"with {WORDS}, {_PLACED.replace('from wk', 'from wb')}, {_LINES.replace('from lo', 'from lw')} select doc_id, page, line_ix::bigint as line_ix, text, fontname, size from li")
def w1_lines(spark, sf):
    """Words grouped into lines with their text and main font."""
    return L.lines(L.line_words(words(spark, sf))).select("doc_id", "page", F.col("line_ix").cast("bigint").alias("line_ix"), "text", "fontname", "size")


_SMALL = f"bl as (select li.*, body from li left join body using (doc_id, page) where not (size > 0 and size < coalesce(body, 10.0) - 0.5 and not regexp_matches(lower(fontname), '{_MONO}')) and text <> '')"


@query("c9_small_lines", f"with {WORDS}, {_PLACED.replace('from wk', 'from wb')}, {_LINES.replace('from lo', 'from lw')}, {_BODY.replace('from wk', 'from words')}, {_SMALL} select doc_id, page, count(*) as n from bl group by all")
def c9_small_lines(spark, sf):
    w = words(spark, sf)
    return L.body_lines(L.lines(L.line_words(w)), L.body_sizes(w)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


_BLOCKS = f"""h as (select bl.*, lv.level, (length(text) < 60 and top < 50 and not regexp_matches(text, '^[0-9]+\\.')) as head from bl left join lv on lv.doc_id = bl.doc_id and lv.size = bl.size),
h2 as (select *, coalesce(max((not head)::int) over (partition by doc_id order by page, line_ix rows between unbounded preceding and 1 preceding), 0) = 1 as begun from h),
k as (select *, case when regexp_matches(lower(fontname), '{_MONO}') then 'code' when contains(lower(fontname), 'bold') and level is not null then 'heading' when starts_with(text, 'Note:') and contains(lower(fontname), 'bold') then 'note' when regexp_matches(text, '^[0-9]+\\.[{SP}]+.') then 'list_item' else 'plain' end as kind from h2 where not head or begun),
k2 as (select *, lag(kind) over p as last, top - lag(bottom) over p as gap, last_value(case when kind <> 'plain' then kind end ignore nulls) over (p rows unbounded preceding) as owner from k window p as (partition by doc_id, page order by line_ix)),
k3 as (select *, coalesce(owner = 'note', false) as noted, case when kind = 'code' then (last is null or last <> 'code')::int when kind <> 'plain' then 1 when coalesce(owner = 'note', false) then 0 when last is null or last <> 'plain' then 1 else (size > 0 and gap > 0.6 * size)::int end as starts from k2),
k4 as (select *, sum(starts) over (partition by doc_id, page order by line_ix rows unbounded preceding) as blk, case when kind <> 'plain' then kind when noted then 'note' else 'paragraph' end as type from k3),
gb as (select doc_id, page, blk, type, min(line_ix) as first, max(coalesce(level, 0)) as level, case when type = 'code' then string_agg(text, chr(10) order by line_ix) else string_agg(text, ' ' order by line_ix) end as text from k4 group by doc_id, page, blk, type),
gf as (select * from gb where type in ('code', 'list_item') or not (regexp_matches(lower({strip_sql('text')}), '^page[{SP}]+[0-9]+') or starts_with(lower({strip_sql('text')}), 'sample file:') or ends_with(lower({strip_sql('text')}), 'page ' || page)))"""

_W3 = f"""with {WORDS}, {PAGES}, {BOXES}, {_LEVELS}, {_KEEP}, {_BODY}, {_PLACED},
lo as (select w.* from lw w where not exists (select 1 from boxes b where {_INSIDE})), {_LINES}, {_SMALL}, {_BLOCKS}
select doc_id, (row_number() over (partition by doc_id order by page, first) - 1)::int as block_ix, type, case when type = 'heading' then {strip_sql(f"regexp_replace(text, '^[0-9]+\\.[{SP}]*', '')")} else text end as text, page, (case when type = 'heading' then level else 0 end)::int as level from gf"""


@query("w3_layout_blocks", _W3)
def w3_layout_blocks(spark, sf):
    """The whole way from words to typed blocks."""
    w = words(spark, sf)
    return L.layout_blocks(w, boxes(spark, sf), pages(spark, sf))


@query(
    "j4_insert_tables",
    """with b as (select distinct doc_id, pos, type, text, page, meta.y_pos as y_pos from block where type <> 'table' or type is null),
t as (select distinct doc_id, page, pos as table_ix, (pos * 37 % 800)::double as top, text from block where type = 'table'),
n as (select t.*, (select min(b.pos) from b where b.type = 'heading' and b.doc_id = t.doc_id and b.page = t.page and b.y_pos > t.top) as before, (select max(b.pos) from b where b.doc_id = t.doc_id and b.page = t.page) as last from t)
select doc_id, coalesce(before, last + 1, 0)::int as pos, (row_number() over (partition by doc_id, page order by top, table_ix) - 1000000)::int as part, 'table' as type, text, page from n
union all select doc_id, pos, 0, type, text, page from b""",
)
def j4_insert_tables(spark, sf):
    """Tables placed before the first heading below them, with a made-up height."""
    raw = table(spark, sf, "block")
    b = raw.where("type <> 'table' or type is null").select("doc_id", "pos", "type", "text", "page", F.col("meta.y_pos").alias("y_pos")).distinct()
    t = raw.where("type = 'table'").select("doc_id", "page", F.col("pos").alias("table_ix"), (F.col("pos") * 37 % 800).cast("double").alias("top"), "text").distinct()
    return L.insert_tables(b, t)


@query(
    "a5_number_images",
    """with i as (select distinct doc_id, page, pos as img_ix, 'x' || case pos % 4 when 0 then '.JPG' when 1 then '.gif' when 2 then '.webp' else '' end as name from block where type = 'image'),
n as (select *, row_number() over (partition by doc_id order by page, img_ix)::int as seq from i)
select doc_id, page, img_ix, name, seq, 'image_' || seq || case img_ix % 4 when 0 then '.jpg' when 1 then '.gif' else '.png' end as filename from n""",
)
def a5_number_images(spark, sf):
    """Images counted and named through each document; their endings are made up."""
    ending = F.when(F.col("pos") % 4 == 0, ".JPG").when(F.col("pos") % 4 == 1, ".gif").when(F.col("pos") % 4 == 2, ".webp").otherwise("")
    i = table(spark, sf, "block").where("type = 'image'").select("doc_id", "page", F.col("pos").alias("img_ix"), F.concat(F.lit("x"), ending).alias("name")).distinct()
    return L.name_images(i)


@query(
    "j5_append_images",
    """with b as (select distinct doc_id, pos, type, text, page from block where type <> 'image' or type is null),
i as (select doc_id, page, name, row_number() over (partition by doc_id order by page, pos)::int as seq from (select distinct doc_id, page, pos, coalesce(text, '') as name from block where type = 'image')),
p as (select doc_id, page, max(last) as last from (select doc_id, page, pos as last from b union all select doc_id, page, null from i) group by all),
q as (select doc_id, page, coalesce(max(last) over (partition by doc_id order by page rows unbounded preceding), -1)::int as last from p)
select doc_id, last as pos, seq as part, 'image' as type, name as text, page from i join q using (doc_id, page) union all select doc_id, pos, 0, type, text, page from b""",
)
def j5_append_images(spark, sf):
    """The images of a page after its blocks."""
    raw = table(spark, sf, "block")
    b = raw.where("type <> 'image' or type is null").select("doc_id", "pos", "type", "text", "page").distinct()
    i = raw.where("type = 'image'").select("doc_id", "page", F.col("pos").alias("img_ix"), F.coalesce("text", F.lit("")).alias("name")).distinct()
    return L.append_images(b, L.number_images(i).select("doc_id", "page", "seq", "name"))
