"""DuckDB SQL for the pN_ queries that SQL can express."""

from __future__ import annotations

_KEYWORD_FORM = "trim(regexp_replace(regexp_replace(lower(translate({w}, '" + "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''") + "　', '" + "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " ')), '\\p{Cf}', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"

_TF = f"""
with r as (select distinct doc_id, topic_ix, keywords from topic where keywords is not null),
e as (select doc_id, topic_ix, {_KEYWORD_FORM.replace("{w}", "w")} as keyword from (select doc_id, topic_ix, unnest(keywords) as w from r)),
tf as (select doc_id, topic_ix, keyword, count(*) as tf from e where keyword <> '' group by all)
"""

P1_FOUND = _TF + "select doc_id, topic_ix, keyword from tf where keyword in (select keyword from tf group by keyword having count(*) between 2 and 8)"


def _h(x: str) -> str:
    return f"(case when {x} > 0 then ({x}) * ln({x}) else 0 end)"


P1_SCORES = (
    _TF
    + """, s as (select keyword, count(*) as n_topics, sum(tf) as cf from tf group by keyword),
z as (select doc_id, topic_ix, sum(tf) as size from tf group by all),
n as (select sum(tf) as n from tf),
t as (select doc_id, topic_ix, keyword, tf, n_topics, tf::double as a, (cf - tf)::double as b, (size - tf)::double as c, (n - size - cf + tf)::double as d
      from tf join s using (keyword) join z using (doc_id, topic_ix) cross join n)
select doc_id, topic_ix, keyword, tf::bigint as tf, n_topics::bigint as n_topics, round(greatest(0.0, 2 * ("""
    + " + ".join(map(_h, ("a", "b", "c", "d", "a + b + c + d")))
    + " - "
    + " - ".join(map(_h, ("a + b", "c + d", "a + c", "b + d")))
    + ")), 4) as score from t"
)

_LINES = """
with l as (select distinct doc_id, pos, unnest(range(len(s)))::int as line_ix, unnest(s) as line
           from (select doc_id, pos, string_split(text, chr(10)) as s from block where type in ('paragraph', 'list_item', 'note') and text is not null)),
k as (select doc_id, pos, line_ix, lower(regexp_replace(regexp_replace(line, '[\\s\\p{Z}]+', '', 'g'), '[0-9]+', '0', 'g')) as k from l),
p as (select k.*, d.source, coalesce(nullif(translate(d.text, ' ' || chr(9) || chr(13) || chr(10), ''), ''), d.doc_id::varchar) as cluster, d.captured_at::date as captured from k join documents d using (doc_id) where k.k <> '' and d.source is not null),
m as (select source, count(distinct doc_id) as m from documents where doc_id in (select doc_id from block) group by source),
f as (select source, k from p join m using (source) group by source, k, m having count(distinct doc_id) >= 3 and count(distinct doc_id) * 5 >= m and count(distinct cluster) >= 2 and (min(captured) is null or min(captured) < max(captured)))
"""

P2_FOUND = _LINES + "select distinct doc_id, pos, line_ix from p join f using (source, k)"

P2_CLEAN = (
    _LINES
    + """, g as (select doc_id, pos, list(distinct line_ix) as gone from p join f using (source, k) group by all),
b as (select distinct doc_id, pos, type, text from block),
j as (select b.*, g.gone, string_split(b.text, chr(10)) as s from b left join g using (doc_id, pos))
select doc_id, pos, type, case when gone is null then text else coalesce(array_to_string([s[i + 1] for i in range(len(s)) if not list_contains(gone, i)], chr(10)), '') end as text, coalesce(len(gone), 0)::int as n_removed from j"""
)

P5_FOUND = """
select distinct doc_id, pos from block b
join (select type, min(max_size) as max_size from size_limit where applies_to = 'block' and type is not null and max_size > 0 group by type) s using (type)
where length(b.text) > s.max_size
"""


P2_LINES = (
    _LINES.replace("k as (select doc_id, pos, line_ix, lower(", "k as (select doc_id, pos, line_ix, trim(line) as line, lower(")
    + """select source, min(line) as example, count(distinct doc_id) as n_docs, count(*) as n_lines, count(distinct cluster) as n_texts, count(distinct coalesce(day, date '1900-01-01')) as n_days
from (select p.*, d.captured_at::date as day from p join documents d using (doc_id)) join f using (source, k) group by source, k"""
)

_ALPHABETS = r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Coptic}\p{Cherokee}\p{Georgian}]"
P6_FOUND = rf"""
with t as (select 'block_text' as field, doc_id, pos as ix, text from block union all select 'topic_title', doc_id, topic_ix, title from topic)
select distinct field, doc_id, ix from t
where regexp_matches(text, '[\x{{FF01}}-\x{{FF5E}}\x{{FFE0}}-\x{{FFE6}}\x{{FB00}}-\x{{FB06}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{180E}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]')
or (regexp_matches(text, '\p{{M}}') and nfc_normalize(text) <> text)
or regexp_matches(text, '\p{{Latin}}[\p{{L}}\p{{M}}]*{_ALPHABETS}|{_ALPHABETS}[\p{{L}}\p{{M}}]*\p{{Latin}}')
"""


# A span of 20 words with at most two replaced holds six equal words in a row: lines through those are compared word by word.
P8_FOUND = r"""
with d as (select doc_id, unnest(w) as w, unnest(range(len(w))) as p from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from (select distinct doc_id, text from documents where text is not null))),
i as (select item_id, unnest(w) as w, unnest(range(len(w))) as q from (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as w from (select distinct item_id, text from eval_item where text is not null))),
dg as (select doc_id, p, concat_ws(' ', w, lead(w, 1) over n, lead(w, 2) over n, lead(w, 3) over n, lead(w, 4) over n, lead(w, 5) over n) as g from d window n as (partition by doc_id order by p)),
ig as (select item_id, q, concat_ws(' ', w, lead(w, 1) over n, lead(w, 2) over n, lead(w, 3) over n, lead(w, 4) over n, lead(w, 5) over n) as g from i window n as (partition by item_id order by q)),
lines as (select distinct doc_id, item_id, p - q as shift from dg join ig using (g)),
same as (select doc_id, item_id, shift, q, (d.w = i.w)::int as s from lines join i using (item_id) join d using (doc_id) where d.p = i.q + shift),
spans as (select *, sum(s) over f as n, count(*) over f as m, last_value(s) over f as l from same window f as (partition by doc_id, item_id, shift order by q rows between current row and 19 following))
@"""
_GOOD = "from spans where m = 20 and n >= 18 and s = 1 and l = 1"
P8_ITEMS = (
    P8_FOUND[:-2]
    + f""",
runs as (select doc_id, item_id, shift, count(*) + 19 as n from (select *, q - row_number() over (partition by doc_id, item_id, shift order by q) as run {_GOOD}) group by doc_id, item_id, shift, run),
per as (select item_id, count(distinct doc_id) as n_docs, max(n) as longest from runs group by item_id)
select distinct item_id, suite, coalesce(n_docs, 0)::bigint as n_docs, coalesce(longest, 0)::bigint as longest from eval_item left join per using (item_id)"""
)
P8_FOUND = P8_FOUND[:-2] + "select distinct doc_id, item_id " + _GOOD


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_scores": P1_SCORES, "p2_found": P2_FOUND, "p2_lines": P2_LINES, "p2_clean": P2_CLEAN, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p8_found": P8_FOUND, "p8_items": P8_ITEMS}
