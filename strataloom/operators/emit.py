"""Topic bodies, topic files, maps and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import html_escape, inner_path, map_filename, normal_keywords, stable_id, strip, strip_number, topic_filename, xml_escape

# Document types, roots and the order of elements; so are the class attributes written with the elements below.
DOCTYPES = {t: f'<!DOCTYPE {t} PUBLIC "-//OASIS//DTD DITA {t.title()}//EN" "{t}.dtd">' for t in ("concept", "task", "reference")}
ROOT_CLASSES = {"concept": "- topic/topic concept/concept ", "task": "- topic/topic task/task ", "reference": "- topic/topic       reference/reference "}
TASKBODY_ORDER = ("prereq", "context", "steps", "steps-unordered", "result", "tasktroubleshooting", "example", "postreq")
LAST_IN_CONBODY = ("section", "example", "conbodydiv")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif")


def _el(name: str, css: str, inner: Column) -> Column:
    return F.concat(F.lit(f'<{name} class="{css}">'), inner, F.lit(f"</{name}>"))


def _ordered(df: DataFrame, keys: list[str], order: list[str], line: Column, name: str = "inner") -> DataFrame:
    """Lines of each group joined in order; null lines are left out. A group is one topic."""
    g = df.select(*keys, *order, line.alias("_l")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_l").isNotNull(), F.struct(*order, "_l")))).alias("_p"))
    return g.select(*keys, F.array_join(F.transform("_p", lambda x: x["_l"]), "\n").alias(name))


def concept_bodies(rows: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, body_xml) of concept topics.

    Headings of level 2 and more open a section and close the one before; list items and tables have no place here.
    """
    w = Window.partitionBy("doc_id", "topic_ix").orderBy("pos")
    rows = rows.withColumn("_opens", (F.col("type") == "heading") & (F.col("level") >= 2))
    rows = rows.withColumn("_n", F.sum(F.col("_opens").cast("int")).over(w)).withColumn("_t", html_escape(F.coalesce("text", F.lit(""))))
    head = F.concat(F.when(F.col("_n") > 1, "</section>\n").otherwise(""), F.lit('<section class="- topic/section ">\n'), _el("title", "- topic/title ", F.col("_t")))
    line = (
        F.when(F.col("_opens"), head)
        .when(F.col("type") == "paragraph", _el("p", "- topic/p ", F.col("_t")))
        .when(F.col("type") == "note", _el("note", "- topic/note ", F.col("_t")))
        .when(F.col("type") == "image", F.concat(F.lit('<fig class="- topic/fig "><title class="- topic/title ">Figure</title><image href="'), F.coalesce("text", F.lit("")), F.lit('" class="- topic/image "/></fig>')))
        .when(F.col("type") == "code", _el("codeblock", "+ topic/pre pr-d/codeblock ", F.col("_t")))
    )
    inner = _ordered(rows, ["doc_id", "topic_ix"], ["pos"], line)
    opened = rows.groupBy("doc_id", "topic_ix").agg(F.max("_n").alias("_n"))
    j = inner.join(opened, ["doc_id", "topic_ix"])
    body = F.concat(F.lit('<conbody class="- topic/body  concept/conbody ">\n'), F.when(F.col("inner") != "", F.concat("inner", F.lit("\n"))).otherwise(""), F.when(F.col("_n") > 0, "</section>\n").otherwise(""), F.lit("</conbody>"))
    return j.select("doc_id", "topic_ix", body.alias("body_xml"))


def task_bodies(rows: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, body_xml) of task topics.

    Blocks before the first list item are context, list items steps, code after one an example of the last step,
    everything else after it result.
    """
    w = Window.partitionBy("doc_id", "topic_ix").orderBy("pos")
    x = rows.withColumn("_step", F.sum((F.col("type") == "list_item").cast("int")).over(w)).withColumn("_t", html_escape(F.coalesce("text", F.lit(""))))
    part = F.when(F.col("_step") == 0, "0context").when((F.col("type") == "list_item") | (F.col("type") == "code"), "1steps").otherwise("2result")
    x = x.withColumn("_part", part)
    paras = _ordered(x.where("_part <> '1steps'"), ["doc_id", "topic_ix", "_part"], ["pos"], _el("p", "- topic/p ", F.col("_t")))
    steps = x.where("_part = '1steps'")
    cmd = _el("cmd", "- topic/ph task/cmd ", html_escape(strip_number(F.coalesce("text", F.lit("")))))
    xmp = F.concat(F.lit('<stepxmp class="- topic/itemgroup task/stepxmp "><codeblock class="+ topic/pre pr-d/codeblock ">'), F.col("_t"), F.lit("</codeblock></stepxmp>"))
    each = _ordered(steps, ["doc_id", "topic_ix", "_part", "_step"], ["pos"], F.when(F.col("type") == "list_item", cmd).otherwise(xmp), "step")
    line = F.concat(F.lit('<step class="- topic/li task/step ">\n'), F.col("step"), F.lit("\n</step>"))
    listed = _ordered(each, ["doc_id", "topic_ix", "_part"], ["_step"], line)
    wrap = F.when(F.col("_part") == "0context", F.concat(F.lit('<context class="- topic/section task/context ">\n'), "inner", F.lit("\n</context>")))
    wrap = wrap.when(F.col("_part") == "1steps", F.concat(F.lit('<steps class="- topic/ol task/steps ">\n'), "inner", F.lit("\n</steps>")))
    wrap = wrap.otherwise(F.concat(F.lit('<result class="- topic/section task/result ">\n'), "inner", F.lit("\n</result>")))
    whole = _ordered(paras.unionAll(listed), ["doc_id", "topic_ix"], ["_part"], wrap)
    return whole.select("doc_id", "topic_ix", F.concat(F.lit('<taskbody class="- topic/body task/taskbody ">\n'), "inner", F.lit("\n</taskbody>")).alias("body_xml"))


def table_grid(text: Column) -> Column:
    """Rows of cells of a table block, stored as a JSON grid or as Markdown pipe lines; separator lines are no rows."""
    piped = F.filter(F.split(text, "\n", -1), lambda row: F.contains(row, F.lit("|")) & ~row.rlike(r"^[|\s:-]*$"))
    cells = F.transform(piped, lambda row: F.transform(F.split(F.regexp_replace(strip(row), r"^\||\|$", ""), r"\|", -1), strip))
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<array<string>>")).otherwise(cells)


def clean_grid(grid: Column) -> Column:
    """Cells without line ends and outer blanks; missing cells are empty."""
    return F.transform(grid, lambda row: F.transform(row, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))


def table_xml(grid: Column) -> Column:
    """A table element; the first row is its head and decides the number of columns."""
    cols = F.size(F.element_at(grid, 1))

    def row(cells: Column) -> Column:
        entries = F.transform(cells, lambda c: _el("entry", "- topic/entry ", html_escape(F.coalesce(c, F.lit("")))))
        return F.concat(F.lit('<row class="- topic/row ">'), F.array_join(entries, ""), F.lit("</row>"))

    specs = F.array_join(F.transform(F.sequence(F.lit(1), cols), lambda i: F.concat(F.lit('<colspec colname="c'), i.cast("string"), F.lit('" colnum="'), i.cast("string"), F.lit('" class="- topic/colspec "/>'))), "")
    body = F.array_join(F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), row), "")
    return F.concat(
        F.lit('<table class="- topic/table "><tgroup cols="'), cols.cast("string"), F.lit('" class="- topic/tgroup ">'), specs,
        F.lit('<thead class="- topic/thead ">'), row(F.element_at(grid, 1)), F.lit('</thead><tbody class="- topic/tbody ">'), body, F.lit("</tbody></tgroup></table>"),
    )


def reference_bodies(rows: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, body_xml) of reference topics: tables and paragraphs only; an unreadable table has no line."""
    grid = table_grid(F.col("text"))
    ok = (F.size(grid) > 0) & (F.size(F.element_at(grid, 1)) > 0)
    line = F.when(F.col("type") == "table", F.when(ok, table_xml(grid))).when(F.col("type") == "paragraph", _el("p", "- topic/p ", html_escape(F.coalesce("text", F.lit("")))))
    inner = _ordered(rows, ["doc_id", "topic_ix"], ["pos"], line)
    body = F.concat(F.lit('<refbody class="- topic/body        reference/refbody ">\n<section class="- topic/section ">\n'), F.when(F.col("inner") != "", F.concat("inner", F.lit("\n"))).otherwise(""), F.lit("</section>\n</refbody>"))
    return inner.select("doc_id", "topic_ix", body.alias("body_xml"))


def bodies(rows: DataFrame) -> DataFrame:
    """Bodies of all topics by their type."""
    parts = [f(rows.where(F.col("topic_type") == t)) for t, f in (("concept", concept_bodies), ("task", task_bodies), ("reference", reference_bodies))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def topic_xml(title: Column, body: Column, topic_type: Column, shortdesc: Column, keywords: Column, ident: Column) -> Column:
    """A whole topic: declaration, doctype, root, title, short description, keywords, body."""

    def by_type(f) -> Column:
        return F.when(topic_type == "task", f("task")).when(topic_type == "reference", f("reference")).otherwise(f("concept"))

    doctype = by_type(lambda t: F.lit(DOCTYPES[t]))
    opening = by_type(lambda t: F.concat(F.lit(f'<{t} id="{t}-'), ident, F.lit(f'" xml:lang="en-us" class="{ROOT_CLASSES[t]}">')))
    closing = by_type(lambda t: F.lit(f"</{t}>"))
    short = strip(F.coalesce(shortdesc, F.lit("")))
    kept = F.filter(keywords, lambda k: strip(F.coalesce(k, F.lit(""))) != "")
    words = F.array_join(F.transform(kept, lambda k: _el("keyword", "- topic/keyword ", xml_escape(k))), "")
    prolog = F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.lit('<prolog class="- topic/prolog "><metadata class="- topic/metadata "><keywords class="- topic/keywords ">'), words, F.lit("</keywords></metadata></prolog>")))
    return F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), doctype, opening, _el("title", "- topic/title ", xml_escape(F.coalesce(title, F.lit("")))),
        F.when(short != "", _el("shortdesc", "- topic/shortdesc ", xml_escape(short))), prolog, F.coalesce(body, F.lit("")), closing,
    )


def topic_files(topic: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, filename, title, topic_type, xml, clash) of classified topics.

    Topics of one document with the same title and type have the same file name; both rows stay, marked as a clash.
    """
    name = topic_filename(F.coalesce("title", F.lit("")), F.col("topic_type"))
    ident = stable_id(F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")))
    x = topic.select("doc_id", "topic_ix", name.alias("filename"), "title", "topic_type", topic_xml(F.col("title"), F.col("body_xml"), F.col("topic_type"), F.col("shortdesc"), normal_keywords(F.col("keywords")), ident).alias("xml"))
    return x.withColumn("clash", F.count("*").over(Window.partitionBy("doc_id", "filename")) > 1)


def maps(files: DataFrame, titles: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, filename, xml): the map of each document with a reference per file in order, and a product key if one is known."""
    refs = _ordered(files, ["doc_id"], ["topic_ix"], F.concat(F.lit('<topicref href="'), F.col("filename"), F.lit('" class="- map/topicref "/>')), "refs")
    j = refs.join(titles.select("doc_id", F.col("title").alias("_title")), "doc_id", "left")
    j = j.join(names, "doc_id", "left") if names is not None else j.withColumn("product", F.lit(None).cast("string"))
    key = F.when(F.col("product").isNotNull(), F.concat(F.lit('<keydef keys="product-name" class="+ map/topicref mapgroup-d/keydef ">\n<topicmeta class="- map/topicmeta ">\n<keywords class="- topic/keywords ">\n'), _el("keyword", "- topic/keyword ", xml_escape(F.col("product"))), F.lit("\n</keywords>\n</topicmeta>\n</keydef>")))
    title = F.coalesce("_title", F.lit(""))
    xml = F.concat_ws("\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE map PUBLIC "-//OASIS//DTD DITA Map//EN" "map.dtd">'), F.concat(F.lit('<map id="ditamap-'), stable_id(F.col("doc_id").cast("string")), F.lit('" class="- map/map ">')), _el("title", "- topic/title ", xml_escape(title)), "refs", key, F.lit("</map>"))
    return j.select("doc_id", map_filename(title).alias("filename"), xml.alias("xml"))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (doc_id, href) with ``target``: the file itself if it exists, else the first file with the same bare name.

    Links with a slash or a scheme stay as they are, and so do those that nothing matches.
    """
    bare = F.regexp_replace("href", "^[ctr]_", "")
    exact = files.select(F.col("doc_id").alias("_d1"), F.col("filename").alias("_f")).distinct()
    loose = files.groupBy(F.col("doc_id").alias("_d2"), F.regexp_replace("filename", "^[ctr]_", "").alias("_bare")).agg(F.min("filename").alias("_other"))
    j = links.withColumn("_b", bare).join(exact, (F.col("doc_id") == F.col("_d1")) & (F.col("href") == F.col("_f")), "left").join(loose, (F.col("doc_id") == F.col("_d2")) & (F.col("_b") == F.col("_bare")), "left")
    fixed = F.contains("href", F.lit("/")) | F.startswith("href", F.lit("http"))
    return j.select(*links.columns, F.when(fixed | F.col("_f").isNotNull() | F.col("_other").isNull(), F.col("href")).otherwise(F.col("_other")).alias("target"))


def resolve_images(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Image references (doc_id, href) with ``target``: the stored file, else one of the same stem in the order of IMAGE_ENDINGS."""
    stem = F.regexp_replace("href", r"\.[^.]*$", "")
    have = stored.select(F.col("doc_id").alias("_d1"), F.col("filename").alias("_f")).distinct()
    rank = F.array_position(F.array(*map(F.lit, IMAGE_ENDINGS)), F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    alike = stored.withColumn("_r", rank).where("_r > 0").groupBy(F.col("doc_id").alias("_d2"), F.regexp_replace("filename", r"\.[^.]*$", "").alias("_stem")).agg(F.min_by("filename", F.struct("_r", "filename")).alias("_other"))
    j = refs.withColumn("_s", stem).join(have, (F.col("doc_id") == F.col("_d1")) & (F.col("href") == F.col("_f")), "left").join(alike, (F.col("doc_id") == F.col("_d2")) & (F.col("_s") == F.col("_stem")), "left")
    return j.select(*refs.columns, F.coalesce("_f", "_other", "href").alias("target"))


REFERENCES = {"xref": r"\.dita$", "image": r"."}


def references(files: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """(keys, element, href): the distinct targets of links and images in the markup of each file."""
    found = F.array(*(F.struct(F.lit(e).alias("element"), F.array_distinct(F.regexp_extract_all(xml, F.lit(rf'<{e}\b[^>]*?\bhref="([^"]+)"'), 1)).alias("hrefs")) for e in REFERENCES))
    x = files.select(*keys, F.explode(found).alias("f")).select(*keys, "f.element", F.explode("f.hrefs").alias("href"))
    kept = [(F.col("element") == e) & F.col("href").rlike(ending) for e, ending in REFERENCES.items()]
    return x.where(kept[0] | kept[1])


def _with_targets(xml: Column, element: str, targets: Column) -> Column:
    """The markup with the href of each element of one name replaced by its target, where ``targets`` has one."""
    parts = F.split(xml, rf"<{element}\b", -1)

    def mend(part: Column, i: Column) -> Column:
        tag = F.substring_index(part, ">", 1)
        href = F.regexp_extract(tag, r'\bhref="([^"]+)"', 1)
        new = F.try_element_at(targets, F.concat(F.lit(f"{element} "), href))
        swapped = F.replace(tag, F.concat(F.lit('href="'), href, F.lit('"')), F.concat(F.lit('href="'), new, F.lit('"')))
        return F.when((i == 0) | new.isNull(), part).otherwise(F.concat(swapped, F.substring(part, F.length(tag) + 1, F.length(part))))

    return F.array_join(F.transform(parts, mend), f"<{element}")


def write_references(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Topic files (doc_id, topic_ix, filename, xml, ...) with the links and image references in ``xml`` led to files that exist.

    Links go by ``resolve_links`` to the files of their document, images by ``resolve_images`` to the ``stored`` ones (doc_id, filename).
    Only targets are joined; markup moves only for files of which a reference changes.
    """
    keys = ["doc_id", "topic_ix"]
    refs = references(files.select(*keys, "xml"), keys).distinct()
    links = resolve_links(refs.where("element = 'xref'").select("doc_id", "href").distinct(), files.select("doc_id", "filename").distinct()).withColumn("element", F.lit("xref"))
    if stored is not None:
        images = resolve_images(refs.where("element = 'image'").select("doc_id", "href").distinct(), stored)
        links = links.unionByName(images.withColumn("element", F.lit("image")))
    changed = refs.join(links.where("target <> href"), ["doc_id", "element", "href"])
    targets = changed.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "element", "href"), "target"))).alias("_targets"))  # the references of one topic
    x = files.join(targets, keys, "left")
    mended = _with_targets(_with_targets(F.col("xml"), "xref", F.col("_targets")), "image", F.col("_targets"))
    return x.select(*(F.when(F.col("_targets").isNull(), F.col("xml")).otherwise(mended).alias("xml") if c == "xml" else c for c in files.columns))


def find_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (doc_id, path) with ``filename`` and ``status``: 200 for a file of the document, 404 for none, 403 for a way out of its folder."""
    inner = inner_path(F.col("path"))
    have = files.select(F.col("doc_id").alias("_d"), F.col("filename").alias("_f")).distinct()
    j = asked.withColumn("_p", inner).join(have, (F.col("doc_id") == F.col("_d")) & (F.col("_p") == F.col("_f")), "left")
    return j.select(*asked.columns, F.col("_f").alias("filename"), F.when(F.col("_p").isNull(), 403).when(F.col("_f").isNull(), 404).otherwise(200).alias("status"))


def child_order(tags: Column, order: tuple[str, ...], last: bool = False) -> Column:
    """Child elements (array of structs with ``tag`` and ``ix``) in a stable order by tag.

    With ``last``, the tags in ``order`` come after all others; without, they come in that order before all others.
    """
    known = F.array(*map(F.lit, order))

    def rank(c: Column) -> Column:
        at = F.array_position(known, c["tag"]).cast("int")
        return F.when(at > 0, F.lit(1) if last else at).otherwise(F.lit(0 if last else 99))

    return F.transform(F.array_sort(F.transform(tags, lambda c: F.struct(rank(c).alias("r"), c["ix"].alias("ix"), c["tag"].alias("tag")))), lambda c: c["tag"])
