"""Words with position and font to lines and typed blocks, all with windows, joins and aggregates.

Words are rows (doc_id, page, word_ix, text, x0, x1, top, bottom, fontname, size); table boxes are rows
(doc_id, page, x0, top, x1, bottom). Null fonts count as regular text, null sizes as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import SPACE, is_bold, is_footer, is_monospace, rejoin_hyphens, strip, strip_number
from strataloom.plans.checkpoints import cut
from strataloom.plans.running import numbered, running_total

HEADING_SIZE = 12
LINE_GAP = 4
BOX_SLACK = 2
COVER_SIZE, COVER_WORDS = 30, 40
SCAN_PAGES, SCAN_CHARS = 3, 80
SMALL_TEXT = 0.5
PARAGRAPH_GAP = 0.6
HEADER_CHARS, HEADER_TOP = 60, 50


def scanned_documents(pages: DataFrame) -> DataFrame:
    """Documents whose first pages hold hardly any text: (doc_id, page, text) -> (doc_id)."""
    first = F.when(F.col("page") <= SCAN_PAGES, F.length(strip(F.coalesce("text", F.lit(""))))).otherwise(0)
    return pages.groupBy("doc_id").agg(F.sum(first).alias("n")).where(F.col("n") < SCAN_CHARS).select("doc_id")


def contents_pages(pages: DataFrame) -> DataFrame:
    """Pages with a line that names a table of contents."""
    return pages.where(F.contains(F.lower("text"), F.lit("table of contents"))).select("doc_id", "page").distinct()


def cover_pages(words: DataFrame) -> DataFrame:
    """Pages with very large letters and few words."""
    return words.groupBy("doc_id", "page").agg(F.max("size").alias("m"), F.count("*").alias("n")).where((F.col("m") > COVER_SIZE) & (F.col("n") < COVER_WORDS)).select("doc_id", "page")


def words_outside_tables(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Anti range join: words that no box of their page contains, two units of slack allowed."""
    b = boxes.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("x0").alias("_x0"), F.col("top").alias("_t"), F.col("x1").alias("_x1"), F.col("bottom").alias("_b"))
    inside = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p"))
    inside &= (F.col("x0") >= F.col("_x0") - BOX_SLACK) & (F.col("top") >= F.col("_t") - BOX_SLACK) & (F.col("x1") <= F.col("_x1") + BOX_SLACK) & (F.col("bottom") <= F.col("_b") + BOX_SLACK)
    return words.join(b, inside, "left_anti")


def heading_levels(words: DataFrame) -> DataFrame:
    """(doc_id, size, n, level): the large bold sizes of a document, the largest as level 1."""
    size = F.round("size", 1)
    sizes = words.where(is_bold(F.col("fontname")) & (size > HEADING_SIZE)).groupBy("doc_id", size.alias("size")).agg(F.count("*").alias("n"))
    return sizes.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))


def page_stats(words: DataFrame) -> DataFrame:
    """(doc_id, page, body, n_words, largest, large): what layout needs of each page besides its lines, in one pass over the words.

    ``body`` is that of ``body_sizes``, ``large`` the heading sizes (bold and large) that occur on the page.
    """
    size = F.round("size", 1)
    sizes = words.groupBy("doc_id", "page", size.alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min("word_ix").alias("first"), F.count("*").alias("words"), F.max("size").alias("m"), F.max(is_bold(F.col("fontname"))).alias("bold"))
    heading = F.when(F.col("bold") & (F.col("size") > HEADING_SIZE), F.col("size"))
    return sizes.groupBy("doc_id", "page").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"), F.sum("words").alias("n_words"), F.max("m").alias("largest"), F.collect_list(heading).alias("large"))


def page_levels(stats: DataFrame) -> DataFrame:
    """(doc_id, page, levels): the heading sizes that occur on a page, each with its level in the document, as a map; from ``page_stats``."""
    large = stats.select("doc_id", "page", F.explode("large").alias("size"))
    levels = large.select("doc_id", "size").distinct().withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))
    return large.join(levels, ["doc_id", "size"]).groupBy("doc_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("size", "level"))).alias("levels"))


def body_sizes(words: DataFrame) -> DataFrame:
    """(doc_id, page, body): the size with most characters of a page; of equal ones the first seen."""
    sizes = words.groupBy("doc_id", "page", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min("word_ix").alias("first"))
    return sizes.groupBy("doc_id", "page").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def line_words(words: DataFrame) -> DataFrame:
    """Words with ``line_ix``: a new line starts where the top jumps by LINE_GAP or more from the word before."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.round("top", 1), "x0", "word_ix")
    last = F.lag("top").over(w)
    jump = F.when(last.isNull() | (F.abs(F.col("top") - last) < LINE_GAP), 0).otherwise(1)
    return words.withColumn("_jump", jump).withColumn("line_ix", F.sum("_jump").over(w)).drop("_jump")


def lines(placed: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, text, fontname, size, top, bottom) of words with ``line_ix``.

    The font of a line is the one with most characters, of equal ones the first; top is that of the first word.
    """
    word = F.struct(F.round("top", 1).alias("r"), "x0", "word_ix", "text", "top", F.struct(F.coalesce("fontname", F.lit("")).alias("fontname"), F.round(F.coalesce("size", F.lit(0.0)), 1).alias("size")).alias("font"))
    whole = placed.groupBy("doc_id", "page", "line_ix").agg(F.sort_array(F.collect_list(word)).alias("w"), F.max("bottom").alias("bottom"))
    fonts = F.array_distinct(F.transform("w", lambda x: x["font"]))

    def weight(f: Column, i: Column) -> Column:
        mine = F.filter("w", lambda x: x["font"] == f)
        return F.struct(F.aggregate(mine, F.lit(0), lambda n, x: n + F.length(x["text"])).alias("n"), (-i).alias("i"), f.alias("f"))

    main = F.when(F.size(fonts) == 1, F.element_at(fonts, 1)).otherwise(F.array_max(F.transform(fonts, weight))["f"])
    text = rejoin_hyphens(F.array_join(F.transform("w", lambda x: x["text"]), " "))
    whole = whole.select("doc_id", "page", "line_ix", text.alias("text"), main.alias("f"), F.element_at("w", 1)["top"].alias("top"), "bottom")
    return whole.select("doc_id", "page", "line_ix", "text", "f.fontname", "f.size", "top", "bottom")


def body_lines(all_lines: DataFrame, bodies: DataFrame) -> DataFrame:
    """Lines without small print (except monospace) and without empty ones."""
    j = all_lines.join(bodies, ["doc_id", "page"], "left")
    small = (F.col("size") > 0) & (F.col("size") < F.coalesce("body", F.lit(10.0)) - SMALL_TEXT) & ~is_monospace(F.col("fontname"))
    return j.where(~small & (F.col("text") != "")).drop("body")


def without_running_heads(text_lines: DataFrame) -> DataFrame:
    """Lines without the short ones near the top of a page that come before any other line of their document.

    What a document has before a page is known from one row per page.
    """
    head = (F.length("text") < HEADER_CHARS) & (F.col("top") < HEADER_TOP) & ~F.col("text").rlike(r"^[0-9]+\.")
    x = text_lines.withColumn("_head", head)
    first = x.groupBy("doc_id", "page").agg(F.min(F.when(~F.col("_head"), F.col("line_ix"))).alias("_first"))
    has = F.col("_first").isNotNull().cast("int")
    pages = running_total(first, "doc_id", "page", has, "_pages").select("doc_id", "page", "_first", (F.col("_pages") > has).alias("_begun"))
    x = x.join(pages, ["doc_id", "page"])
    return x.where(~F.col("_head") | F.col("_begun") | F.coalesce(F.col("line_ix") > F.col("_first"), F.lit(False))).select(*text_lines.columns)


def blocks(text_lines: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, block_ix, type, text, page, level) of body lines; ``levels`` are those of ``page_levels``.

    Monospace runs are code, large bold lines headings, bold lines with "Note:" notes that take in the plain lines after
    them, numbered lines list items; other lines join into paragraphs until the gap exceeds 0.6 of the font size.
    Runs end with the page. Short first lines near the top of the document are running heads; blocks that look
    like page footers are dropped. No window is wider than a page.
    """
    x = without_running_heads(text_lines).join(levels, ["doc_id", "page"], "left").withColumn("level", F.try_element_at("levels", F.col("size"))).drop("levels")
    kind = (
        F.when(is_monospace(F.col("fontname")), "code")
        .when(is_bold(F.col("fontname")) & F.col("level").isNotNull(), "heading")
        .when(F.startswith("text", F.lit("Note:")) & is_bold(F.col("fontname")), "note")
        .when(F.col("text").rlike(f"^[0-9]+\\.[{SPACE}]+."), "list_item")
        .otherwise("plain")
    )
    page = Window.partitionBy("doc_id", "page").orderBy("line_ix")
    x = x.withColumn("kind", kind).withColumn("_last", F.lag("kind").over(page)).withColumn("_gap", F.col("top") - F.lag("bottom").over(page))
    x = x.withColumn("_owner", F.last(F.when(F.col("kind") != "plain", F.col("kind")), ignorenulls=True).over(page))
    noted = F.coalesce(F.col("_owner") == "note", F.lit(False))
    starts = (
        F.when(F.col("kind") == "code", ~F.col("_last").eqNullSafe("code"))
        .when(F.col("kind") != "plain", True)
        .when(noted, False)
        .when(~F.col("_last").eqNullSafe("plain"), True)
        .otherwise((F.col("size") > 0) & (F.col("_gap") > PARAGRAPH_GAP * F.col("size")))
    )
    x = x.withColumn("_block", F.sum(starts.cast("int")).over(page)).withColumn("type", F.when(F.col("kind") != "plain", F.col("kind")).when(noted, "note").otherwise("paragraph"))
    g = x.groupBy("doc_id", "page", "_block", "type").agg(F.min("line_ix").alias("first"), F.max(F.coalesce("level", F.lit(0))).alias("level"), F.sort_array(F.collect_list(F.struct("line_ix", "text"))).alias("parts"))
    parts = F.transform("parts", lambda p: p["text"])
    g = g.withColumn("text", F.when(F.col("type") == "code", F.array_join(parts, "\n")).otherwise(F.array_join(parts, " ")))
    g = g.where(F.col("type").isin("code", "list_item") | ~is_footer(F.col("text"), F.col("page")))
    g = numbered(g.drop("parts"), "doc_id", "page", ["first"], "block_ix")
    return g.select("doc_id", "block_ix", "type", F.when(F.col("type") == "heading", strip_number(F.col("text"))).otherwise(F.col("text")).alias("text"), "page", F.when(F.col("type") == "heading", F.col("level")).otherwise(0).cast("int").alias("level"))


def layout_blocks(words: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """The whole way from words to blocks, without contents and cover pages and without table words."""
    stats = cut(page_stats(words))  # one row per page, read three times below
    covers = stats.where((F.col("largest") > COVER_SIZE) & (F.col("n_words") < COVER_WORDS)).select("doc_id", "page")
    kept = words.join(contents_pages(pages).unionAll(covers).distinct(), ["doc_id", "page"], "left_anti")
    outside = words_outside_tables(line_words(kept), boxes)
    text_lines = cut(body_lines(lines(outside), stats.select("doc_id", "page", "body")))  # read four times below
    return blocks(text_lines, page_levels(stats))


def insert_tables(block: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with tables among them: (doc_id, pos, part, type, text, page).

    A table goes before the first heading of its page that lies below it (y_pos > top), else after the page's blocks.
    ``block`` has y_pos for headings; ``tables`` is (doc_id, page, table_ix, top, text).
    """
    heads = block.where("type = 'heading' and y_pos is not null").select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("pos").alias("_pos"), "y_pos")
    near = tables.join(heads, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (F.col("y_pos") > F.col("top")), "left")
    near = near.groupBy("doc_id", "page", "table_ix", "top", "text").agg(F.min("_pos").alias("before"))
    ends = block.groupBy("doc_id", "page").agg(F.max("pos").alias("last"))
    placed = near.join(ends, ["doc_id", "page"], "left").select("doc_id", F.coalesce(F.col("before"), F.col("last") + 1, F.lit(0)).alias("pos"), F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top", "table_ix")).alias("part"), F.lit("table").alias("type"), "text", "page")
    placed = placed.withColumn("part", F.col("part") - 1_000_000)
    return block.select("doc_id", "pos", F.lit(0).alias("part"), "type", "text", "page").unionAll(placed)


def append_images(block: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks with images after the last block of their page: (doc_id, pos, part, type, text, page).

    ``images`` is (doc_id, page, seq, name); those of a page without blocks follow the last block of an earlier page.
    """
    ends = block.groupBy("doc_id", "page").agg(F.max("pos").alias("last"))
    upto = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = ends.unionByName(images.select("doc_id", "page").distinct().withColumn("last", F.lit(None).cast("int"))).groupBy("doc_id", "page").agg(F.max("last").alias("last"))
    pages = pages.withColumn("last", F.coalesce(F.max("last").over(upto), F.lit(-1)))
    placed = images.join(pages, ["doc_id", "page"]).select("doc_id", F.col("last").alias("pos"), F.col("seq").cast("int").alias("part"), F.lit("image").alias("type"), F.col("name").alias("text"), "page")
    return block.select("doc_id", "pos", F.lit(0).alias("part"), "type", "text", "page").unionAll(placed)


def number_images(images: DataFrame) -> DataFrame:
    """Images with ``seq``, counted from 1 through the document by page and place."""
    return numbered(images, "doc_id", "page", ["img_ix"], "seq").withColumn("seq", F.col("seq") + 1)


#: Endings an extracted image keeps; others become .png.
KNOWN_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".tif", ".tiff", ".bmp")


def name_images(images: DataFrame, original: str = "name") -> DataFrame:
    """``number_images`` with ``filename``: image_ and the number, with the ending of the original name if it is a known one."""
    ending = F.lower(F.regexp_extract(F.coalesce(original, F.lit("")), r"(\.[^./]+)$", 1))
    return number_images(images).withColumn("filename", F.concat(F.lit("image_"), F.col("seq").cast("string"), F.when(ending.isin(*KNOWN_ENDINGS), ending).otherwise(".png")))
