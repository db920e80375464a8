"""Queries of the scalar functions, over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.plans.tables import table
from strataloom.queries.registry import SP, WD, esc_sql, name_sql, query, slug_sql, strip_sql, xesc_sql

C = F.col


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "topic").select("doc_id", "topic_ix", "title", "topic_type", "body_xml", "shortdesc", "keywords").distinct()


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "block").select("doc_id", "pos", "type", "text", "page").distinct()


_T = "from (select distinct doc_id, topic_ix, title, topic_type, body_xml, shortdesc, keywords from topic)"
_B = "from (select distinct doc_id, pos, type, text, page from block)"


def _topic_query(name: str, column, sql: str):
    @query(name, f"select doc_id, topic_ix, {sql} as value {_T}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _topics(spark, sf).select("doc_id", "topic_ix", column().alias("value"))


def _block_query(name: str, column, sql: str):
    @query(name, f"select doc_id, pos, {sql} as value {_B}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _blocks(spark, sf).select("doc_id", "pos", column().alias("value"))


_HYPHEN = f"regexp_replace({{x}}, '([{WD}])[{SP}]+[‑-][{SP}]+([{WD}])', '\\1-\\2', 'g')"
_block_query(
    "f1_rejoin_hyphens", lambda: T.rejoin_hyphens(F.concat(F.lit("cost ‑ to - market "), C("text"))),
    _HYPHEN.replace("{x}", _HYPHEN.replace("{x}", strip_sql("('cost ‑ to - market ' || text)"))),
)
_block_query("f2_strip_number", lambda: T.strip_number(C("text")), strip_sql(f"regexp_replace(text, '^[0-9]+\\.[{SP}]*', '')"))
_topic_query("f3_slug", lambda: T.slug(C("title")), slug_sql("title"))
_topic_query("f4_topic_filename", lambda: T.topic_filename(C("title"), C("topic_type")), name_sql("title", "topic_type"))
_topic_query("f5_map_filename", lambda: T.map_filename(C("title")), f"'m_' || {slug_sql('title')} || '.ditamap'")
_block_query("f6_xml_escape", lambda: T.xml_escape(C("text")), xesc_sql("text"))
_block_query("f7_html_escape", lambda: T.html_escape(C("text")), esc_sql("text"))


def _array(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_topic_query(
    "f8_strip_preamble",
    lambda: T.strip_preamble(F.concat(
        F.lit("<BODY><p>Kept.</p><P class='x'> This "), F.element_at(F.array(*map(F.lit, T.PREAMBLE_NOUNS)), (C("topic_ix") % 5 + 1).cast("int")), F.lit("\n"),
        F.element_at(F.array(*map(F.lit, T.PREAMBLE_VERBS)), (C("doc_id") % 8 + 1).cast("int")), F.lit(" the screen. "), C("body_xml"),
    )),
    f"""'<BODY><p>Kept.</p><P class=''x''>' || regexp_replace(' This ' || ({_array(T.PREAMBLE_NOUNS)})[topic_ix % 5 + 1] || chr(10) || ({_array(T.PREAMBLE_VERBS)})[doc_id % 8 + 1] || ' the screen. ' || body_xml,
 '^[^.]*\\.\\s*', '')""",
)
_block_query("f9_strip_invisible", lambda: T.strip_invisible(C("text")), "regexp_replace(text, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]|&#x?200[bcdBCD];', '', 'g')")
_block_query(
    "f10_drop_etc", lambda: T.drop_etc(F.concat(F.lit("Fees, taxes, etc. Also: "), C("text"), F.lit(", etc."))),
    r"regexp_replace(regexp_replace('Fees, taxes, etc. Also: ' || text || ', etc.', ',\s+etc\.\s+', '. ', 'g'), ',\s+etc\.([<\s]|$)', '.\1', 'g')",
)
_block_query(
    "f10_write_out", lambda: T.write_out(F.concat(F.lit("Sent via x, e.g. y, i.e. z. "), C("text"))),
    r"regexp_replace(regexp_replace(regexp_replace('Sent via x, e.g. y, i.e. z. ' || text, '\bi\.e\.', 'that is', 'g'), '\be\.g\.', 'for example', 'g'), '\bvia\b', 'through', 'g')",
)
# the slips are made first: every quote escaped, every class attribute closed by a second quote, tags inside every class attribute
_topic_query("f11_unescape_quotes", lambda: T.unescape_quotes(F.replace(C("body_xml"), F.lit('"'), F.lit('\\"'))), "body_xml")
_topic_query(
    "f12_close_class_attribute", lambda: T.close_class_attribute(F.replace(C("body_xml"), F.lit('">'), F.lit('" "'))),
    r"""regexp_replace(replace(body_xml, '">', '" "'), '(\bclass="[^"]*")\s*"([^<>"]*)(<|$)', '\1>\2\3', 'g')""",
)
_topic_query(
    "f13_escape_tags_in_attributes", lambda: T.escape_tags_in_attributes(F.replace(C("body_xml"), F.lit('class="'), F.lit('title="<b>a</b> <i/> < <br >" class="'))),
    """replace(body_xml, 'class="', 'title="&lt;b>a</b> &lt;i/> < &lt;br >" class="')""",
)
_DOUBLE = "<row><entry>x</entry>\n</entry></row> </row>"
_topic_query(
    "f14_collapse_double_close", lambda: T.collapse_double_close(F.concat(F.lit(_DOUBLE), C("body_xml"))),
    rf"""regexp_replace(regexp_replace('{_DOUBLE}' || body_xml, '</entry>\s*</entry>', '</entry>', 'g'), '</row>\s*</row>', '</row>', 'g')""",
)
_GROUPS = '<tgroup cols="1"></tgroup><tgroup><tbody/></tgroup>'
_topic_query(
    "f15_fill_table_groups", lambda: T.fill_table_groups(F.concat(F.lit(_GROUPS), C("body_xml"))),
    f"""(select array_to_string([case when i < len(s) and regexp_extract(s[i], '(?s)^.*(<tgroup.*)$', 1) <> '' and not contains(regexp_extract(s[i], '(?s)^.*(<tgroup.*)$', 1), '<tbody') then s[i] || '{T.EMPTY_TBODY}' else s[i] end
 for i in range(1, len(s) + 1)], '</tgroup>') from (select string_split('{_GROUPS}' || body_xml, '</tgroup>') as s))""",
)
_WRAPPED = rf"""replace(regexp_replace(regexp_replace(regexp_replace({strip_sql('shortdesc')}, '(\p{{L}}{{2}}-)(\p{{L}}{{2}})', '\1' || chr(1) || '\2', 'g'), '(\p{{L}}{{2}}-)(\p{{L}}{{2}})', '\1' || chr(1) || '\2', 'g'), '[{SP}]+', ' ', 'g'), ' ', chr(1) || ' ')"""
_topic_query(
    "f16_wrap_text", lambda: T.wrap(C("shortdesc")),
    rf"case when length(shortdesc) <= 80 then shortdesc else list_reduce(string_split({_WRAPPED}, chr(1)), lambda a, p: case when length(regexp_extract(a, '[^\n]*$')) + length(p) <= 80 then a || p else a || chr(10) || ltrim(p) end) end",
)
_topic_query("f17_strip_doctype", lambda: T.strip_doctype(F.concat(F.lit('<!DOCTYPE topic SYSTEM "x.dtd">'), C("body_xml"))), "regexp_replace('<!DOCTYPE topic SYSTEM \"x.dtd\">' || body_xml, '<!DOCTYPE[^>]+>', '', 'g')")
_block_query("f18_word_set", lambda: F.array_join(F.array_sort(T.word_set(C("text"))), " "), f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[{WD}]+'))), ' ')")
_topic_query(
    "f20_markup_text", lambda: T.markup_text(C("body_xml")),
    rf"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(body_xml, '<!DOCTYPE[^>]+>', '', 'g'), '(?s)<\?.*?\?>|<!--.*?-->', '', 'g'), '<[^>]*>'), lambda x: {strip_sql('x')}), lambda x: x <> ''), ' ')",
)
_topic_query("f22_cache_key", lambda: T.cache_key(C("title"), C("body_xml")), "substring(sha256(title || chr(31) || body_xml), 1, 16)")
_topic_query("f23_strip_fences", lambda: T.strip_fences(F.concat(F.lit("```xml\n"), C("body_xml"), F.lit("\n```"))), strip_sql(rf"regexp_replace(regexp_replace({strip_sql('''('```xml' || chr(10) || body_xml || chr(10) || '```')''')}, '^```[A-Za-z0-9_]*\s*\n?', ''), '\n?\s*```\s*$', '')"))
_topic_query(
    "f26_normal_keywords", lambda: F.array_join(T.normal_keywords(C("keywords")), "|"),
    f"array_to_string(list_slice(list_transform(list_filter(keywords, lambda k: {strip_sql('''coalesce(k, '')''')} <> ''), lambda k: substring(lower({strip_sql('k')}), 1, 40)), 1, 7), '|')",
)
_topic_query("f27_domain_name", lambda: T.domain_name(C("body_xml"), "ui-d"), "nullif(regexp_extract(body_xml, 'ui-d/([A-Za-z0-9_]+)', 1), '')")
_block_query("c3_footers", lambda: T.is_footer(C("text"), C("page")), f"regexp_matches(lower({strip_sql('text')}), '^page[{SP}]+[0-9]+') or starts_with(lower({strip_sql('text')}), 'sample file:') or ends_with(lower({strip_sql('text')}), 'page ' || page)")
_block_query("c4_headers", lambda: T.is_header(C("text")), f"length({strip_sql('text')}) < 60 and not ends_with({strip_sql('text')}, '.')")
_block_query("f21_product_name", lambda: T.product_name(F.concat(F.lit("See XYZ's "), C("text"))), f"nullif(regexp_extract('See XYZ''s ' || text, '(?:^|[^{WD}])([A-Z]{{2,}})''s[{SP}]+', 1), '')")


@query("f19_f1", "select doc_id, topic_ix, case when p + r = 0 then 0.0 else round(2 * p * r / (p + r), 9) end as value from (select doc_id, topic_ix, (topic_ix % 5) / 4.0::double as p, (doc_id % 7) / 6.0::double as r " + _T + ")")
def f19_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _topics(spark, sf).select("doc_id", "topic_ix", F.round(T.f1((C("topic_ix") % 5) / F.lit(4.0), (C("doc_id") % 7) / F.lit(6.0)), 9).alias("value"))


@query("f29_title_from_filename", "select distinct doc_id, topic_ix, filename, array_to_string(list_transform(string_split(replace(regexp_replace(regexp_replace(filename, '\\.dita$', ''), '^[ctr]_', ''), '_', ' '), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') as title from out_file")
def f29_title_from_filename(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "out_file").select("doc_id", "topic_ix", "filename", T.title_from_filename(C("filename")).alias("title")).distinct()


@query("c19_type_from_prefix", "select distinct doc_id, topic_ix, case when filename like 't\\_%' escape '\\' then 'task' when filename like 'r\\_%' escape '\\' then 'reference' else 'concept' end as prefix_type, topic_type from out_file")
def c19_type_from_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "out_file").select("doc_id", "topic_ix", T.type_from_prefix(C("filename")).alias("prefix_type"), "topic_type").distinct()


@query(
    "a8_document_titles",
    f"select distinct doc_id, case when length({strip_sql('title')}) > 3 then {strip_sql('title')} else array_to_string(list_transform(string_split(replace(replace(source, '_', ' '), '-', ' '), ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') end as title from documents",
)
def a8_document_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The stored title, else the name of the source as a file stem in title case."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.document_title(C("title"), F.concat(F.lit("in/"), C("source"), F.lit(".pdf"))).alias("title")).distinct()


@query(
    "f30_retry_delay",
    "select client_id, name, ts, greatest(1.0, least(20.0, time))::double as hinted, case when status = 'error' then greatest(least(pow(1.5, a), 20.0), 5.0) else least(pow(1.5, a), 20.0) end as backoff "
    "from (select distinct client_id, name, status, time, ts, extract(hour from ts) % 6 as a from stage_event where time is not null and status is not null)",
)
def f30_retry_delay(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "stage_event").where("time is not null and status is not null").select("client_id", "name", "status", "time", "ts").distinct()
    attempt = (F.hour("ts") % 6).cast("double")
    return ev.select("client_id", "name", "ts", T.retry_delay(attempt, C("time"), F.lit(False)).alias("hinted"), T.retry_delay(attempt, F.lit(None).cast("double"), C("status") == "error").alias("backoff"))


@query("f31_retry_hint", "select distinct client_id, ts, try_cast(nullif(regexp_extract('Please retry in ' || time || 's. ' || coalesce(detail, ''), '(?i)retry in\\s+([0-9.]+)s', 1), '') as double) as hint from stage_event where time is not null")
def f31_retry_hint(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "stage_event").where("time is not null")
    return ev.select("client_id", "ts", T.retry_hint(F.concat(F.lit("Please retry in "), C("time").cast("string"), F.lit("s. "), F.coalesce("detail", F.lit("")))).alias("hint")).distinct()


_MODELS = ("Claude-3", "gemini-flash", "Kimi-K2", "moonshot-v1-8k", "other")


@query("f32_provider", f"select distinct client_id, name, (['claude', 'gemini', 'kimi', 'kimi', 'gemini'])[(length(client_id) + length(name)) % 5 + 1] as provider, ({_array(_MODELS)})[(length(client_id) + length(name)) % 5 + 1] as model from stage_event where name is not null")
def f32_provider(spark: SparkSession, sf: str) -> DataFrame:
    """Model names of every provider, given to the clients by the length of their names."""
    ev = table(spark, sf, "stage_event").where("name is not null").select("client_id", "name").distinct()
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.length("client_id") + F.length("name")) % 5 + 1)
    return ev.select("client_id", "name", T.provider_of(model).alias("provider"), model.alias("model"))


@query("f33_safe_names", "select distinct doc_id, topic_ix, substring(sha256(doc_id || '/' || topic_ix), 1, 8) || '_' || case topic_ix % 4 when 3 then 'upload.pdf' else filename end as name from out_file")
def f33_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of files handed in with folders of both kinds, with a way out of the folder, and without a name."""
    path = F.when(C("topic_ix") % 4 == 0, C("filename")).when(C("topic_ix") % 4 == 1, F.concat(F.lit("../../etc/"), "filename")).when(C("topic_ix") % 4 == 2, F.concat(F.lit("C:\\tmp\\"), "filename")).otherwise("..")
    ident = F.concat_ws("/", C("doc_id").cast("string"), C("topic_ix").cast("string"))
    return table(spark, sf, "out_file").select("doc_id", "topic_ix", T.safe_upload_name(path, ident).alias("name")).distinct()


@query("f35_half_even", "select distinct doc_id, (case when (n_chars % 4) = 2 then 2 * (((n_chars // 4) + 1) // 2) else round(n_chars / 4.0) end)::bigint as quarter from documents where n_chars is not null")
def f35_half_even(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("n_chars is not null")
    return docs.select("doc_id", T.python_round(C("n_chars") / F.lit(4.0), 0).cast("bigint").alias("quarter")).distinct()


@query("f37_human_size", "select distinct doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f', n_chars / 1024.0) || ' KB' else printf('%.1f', n_chars / 1048576.0) || ' MB' end as size from (select doc_id, n_chars * case doc_id % 3 when 0 then 1 when 1 then 3 else 1000 end as n_chars from documents where n_chars is not null)")
def f37_human_size(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("n_chars is not null")
    n = C("n_chars") * F.when(C("doc_id") % 3 == 0, 1).when(C("doc_id") % 3 == 1, 3).otherwise(1000)
    return docs.select("doc_id", T.human_size(n).alias("size")).distinct()


@query("f28_validator", "select distinct client_id, name, ts, not contains(log, 'Build failed') and not regexp_matches(log, '\\[DOT[XJA][0-9]{3}[EF]\\]') and rc = 0 as passed from (select client_id, name, ts, coalesce(detail, '') || case when status = 'error' then ' [DOTJ013E]' when status = 'skipped' then ' Build failed' else '' end as log, case when status is null then 1 else 0 end as rc from stage_event)")
def f28_validator(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "stage_event")
    log = F.concat(F.coalesce("detail", F.lit("")), F.when(C("status") == "error", " [DOTJ013E]").when(C("status") == "skipped", " Build failed").otherwise(""))
    return ev.select("client_id", "name", "ts", T.validator_passed(log, F.when(C("status").isNull(), 1).otherwise(0)).alias("passed")).distinct()
