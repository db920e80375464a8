"""Blocks to sections to planned topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import SPACE, product_name, strip
from strataloom.plans.checkpoints import cut
from strataloom.plans.running import running_total

# What titles and texts of the topic types contain.
REFERENCE_WORDS = ("settings", "parameters", "fields", "properties", "reference", "specifications", "configuration")
TASK_PHRASES = ("to set up", "to create", "to configure", "how to", "procedure", "steps to")
VERBS = ("click", "select", "enter", "choose", "set up", "configure", "create", "run", "open", "navigate", "submit", "complete", "specify", "verify", "check", "type", "press")
TABLE_SHARE = 0.3
ECHO_CHARS = 80


def distinct_blocks(block: DataFrame) -> DataFrame:
    """Block rows, each once however often it was delivered: (doc_id, pos, type, text, page, level)."""
    return block.select("doc_id", "pos", "type", "text", "page", "level").distinct()


def clean_blocks(block: DataFrame) -> DataFrame:
    """Blocks without paragraphs that echo a heading of their document or are page footers.

    An anti join on the hash of (document, text); null texts stay.
    """
    norm = F.lower(strip(F.col("text")))
    heads = block.where("type = 'heading' and text is not null").where(F.length(norm) < ECHO_CHARS).select(F.xxhash64("doc_id", norm).alias("_h")).distinct()
    paras = block.where("type = 'paragraph'").where(norm.isNull() | ~norm.rlike(f"^(page[{SPACE}]+[0-9]+|sample file:)"))
    paras = paras.withColumn("_n", F.when(F.length(norm) < ECHO_CHARS, F.xxhash64("doc_id", norm))).join(heads, F.col("_n") == F.col("_h"), "left_anti").drop("_n")
    return block.where("type <> 'paragraph' or type is null").unionByName(paras)


def planning_rows(block: DataFrame) -> DataFrame:
    """What planning needs of each block, each once: (doc_id, pos, type, level, page, text, verbs).

    Only headings keep their text; of other texts stay the bits of the VERBS they hold and the hash of their folded
    form, so that what is shuffled from here on does not grow with the texts. Echoes and footers are left out.
    """
    head = F.col("type") == "heading"
    # worked out once for all that is asked of it below
    low = block.select("doc_id", "pos", "type", "level", "page", F.when(head, F.col("text")).alias("text"), F.lower("text").alias("low"))
    low = low.select("doc_id", "pos", "type", "level", "page", "text", "low", strip(F.col("low")).alias("norm"))
    bits = F.lit(0)
    for i, v in enumerate(VERBS):
        bits = bits + F.when(F.contains("low", F.lit(v)), 1 << i).otherwise(0)
    slim = low.select(
        "doc_id", "pos", "type", "level", "page", "text", F.when(~head, bits).otherwise(0).alias("verbs"),
        F.xxhash64("norm").alias("hash"), (F.col("norm").isNotNull() & (F.length("norm") < ECHO_CHARS)).alias("short"),
        F.coalesce((F.col("type") == "paragraph") & F.col("norm").rlike(f"^(page[{SPACE}]+[0-9]+|sample file:)"), F.lit(False)).alias("footer"),
    )
    slim = slim.where("not footer").distinct()
    title = strip(F.lower("text"))
    heads = block.where("type = 'heading' and text is not null").where(F.length(title) < ECHO_CHARS).select(F.col("doc_id").alias("_d"), F.xxhash64(title).alias("_h")).distinct()
    echo = (F.col("doc_id") == F.col("_d")) & (F.col("hash") == F.col("_h")) & (F.col("type") == "paragraph") & F.col("short")
    return slim.join(heads, echo, "left_anti").select("doc_id", "pos", "type", "level", "page", "text", "verbs")


def section_blocks(block: DataFrame) -> DataFrame:
    """Blocks with ``section_ix``, 0 for those before the first heading; positions must be unique in a document."""
    return running_total(block, "doc_id", "pos", F.when(F.col("type") == "heading", 1).otherwise(0), "section_ix")


def sections(placed: DataFrame) -> DataFrame:
    """(doc_id, section_ix, title, level, page_start, n_blocks, n_tables, n_items, verbs) of rows with ``section_ix``.

    ``placed`` are planning rows or whole blocks. One row per section with what the topic rules need, combined before
    the shuffle: block counts by type, and how many of VERBS occur in its texts. Blocks before the first heading are
    "Introduction" on level 1.
    """
    body = F.col("type") != "heading"
    if "verbs" not in placed.columns:
        low = F.lower(F.coalesce("text", F.lit("")))
        bits = F.lit(0)
        for i, v in enumerate(VERBS):
            bits = bits + F.when(F.contains(low, F.lit(v)), 1 << i).otherwise(0)
        placed = placed.withColumn("verbs", F.when(body, bits).otherwise(0))
    g = placed.groupBy("doc_id", "section_ix").agg(
        F.max(F.when(~body, F.struct("text", "level", "page"))).alias("h"), F.min_by("page", "pos").alias("page_start"),
        F.count_if(body).alias("n_blocks"), F.count_if(F.col("type") == "table").alias("n_tables"), F.count_if(F.col("type") == "list_item").alias("n_items"), F.bit_or("verbs").alias("bits"),
    )
    return g.select("doc_id", "section_ix", F.when(F.col("section_ix") == 0, "Introduction").otherwise(F.col("h.text")).alias("title"), F.when(F.col("section_ix") == 0, 1).otherwise(F.col("h.level")).alias("level"), "page_start", "n_blocks", "n_tables", "n_items", F.bit_count("bits").alias("verbs"))


def topic_type(secs: DataFrame) -> DataFrame:
    """Sections with ``topic_type``: reference by table share or title, task by steps with verbs or title, else concept."""
    t = F.lower(F.coalesce("title", F.lit("")))
    kind = (
        F.when(F.col("n_tables") > TABLE_SHARE * F.greatest("n_blocks", F.lit(1)), "reference")
        .when(t.rlike("|".join(REFERENCE_WORDS)), "reference")
        .when((F.col("n_items") > 0) & (F.col("verbs") >= 2), "task")
        .when(t.rlike("|".join(TASK_PHRASES)), "task")
        .otherwise("concept")
    )
    return secs.withColumn("topic_type", kind)


def plan_topics(typed: DataFrame) -> DataFrame:
    """Sections with ``topic_ix``: runs of concepts merge while their level is not below that of the first one.

    A section starts a topic unless it is a concept after a concept whose level is not under all earlier levels of
    its run: a running minimum instead of a loop. Windows over sections, of which even a huge document has few.
    """
    doc = Window.partitionBy("doc_id").orderBy("section_ix")
    concept = F.col("topic_type") == "concept"
    x = typed.withColumn("_c", concept).withColumn("_run", F.sum((~concept | ~F.coalesce(F.lag(concept).over(doc), F.lit(False))).cast("int")).over(doc))
    before = Window.partitionBy("doc_id", "_run").orderBy("section_ix").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min("level").over(before)
    x = x.withColumn("_head", ~F.col("_c") | least.isNull() | (F.col("level") < least))
    return x.withColumn("topic_ix", F.sum(F.col("_head").cast("int")).over(doc) - 1).drop("_c", "_run")


def topics(planned: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, topic_title, topic_type, section_indices, reasoning) of planned sections."""
    g = planned.groupBy("doc_id", "topic_ix").agg(F.max(F.when(F.col("_head"), F.struct("title", "topic_type"))).alias("h"), F.sort_array(F.collect_list("section_ix")).alias("section_indices"))
    n = F.size("section_indices")
    why = F.when(F.col("h.topic_type") == "concept", F.concat(F.lit("merged "), n.cast("string"), F.lit(" concept sections"))).otherwise("standalone")
    return g.select("doc_id", "topic_ix", F.col("h.title").alias("topic_title"), F.col("h.topic_type").alias("topic_type"), "section_indices", why.alias("reasoning"))


def topic_blocks(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, topic_ix, pos, type, text, page, level): the blocks of each topic in order.

    The heading of a topic's first section is its title and no block; those of merged sections become headings of level 2.
    """
    secs = planned.select("doc_id", "section_ix", "topic_ix", "_head", "topic_type", F.col("title").alias("_title"))
    j = placed.join(secs, ["doc_id", "section_ix"])
    j = j.where((F.col("type") != "heading") | ~F.col("_head"))
    return j.select("doc_id", "topic_ix", "topic_type", "pos", "type", "text", "page", F.when(F.col("type") == "heading", 2).otherwise(F.col("level")).alias("level"))


def place_blocks(block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Planning rows with ``section_ix``, written once to a checkpoint as both plan and topics are made of them, and the planned sections."""
    rows = cut(section_blocks(planning_rows(block)))
    return rows, plan_topics(topic_type(sections(rows)))


def topic_texts(block: DataFrame, rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``topic_blocks`` with the texts of ``block``, which meet the narrow rows once and are moved only for that.

    Positions must be unique in a document; rows delivered twice come out once.
    """
    keyed = topic_blocks(rows, planned).drop("text")
    joined = block.select("doc_id", "pos", "text").join(keyed, ["doc_id", "pos"]).dropDuplicates(["doc_id", "pos"])
    return joined.select("doc_id", "topic_ix", "topic_type", "pos", "type", "text", "page", "level")


def empty_topics(planned: DataFrame) -> DataFrame:
    """(doc_id, topics, skipped): topics planned, and those without any block that will be skipped."""
    per = planned.groupBy("doc_id", "topic_ix").agg(F.sum("n_blocks").alias("n"), F.count("*").alias("sections"))
    return per.groupBy("doc_id").agg(F.count("*").alias("topics"), F.count_if((F.col("n") == 0) & (F.col("sections") == 1)).alias("skipped"))


def products(block: DataFrame) -> DataFrame:
    """(doc_id, product): the first product name in the paragraphs and list items of a document."""
    named = block.where(F.col("type").isin("paragraph", "list_item")).select("doc_id", "pos", product_name(F.col("text")).alias("p")).where("p is not null")
    return named.groupBy("doc_id").agg(F.min_by("p", "pos").alias("product"))


def previews(placed: DataFrame, blocks: int = 3, chars: int = 100, total: int = 200) -> DataFrame:
    """(doc_id, section_ix, preview): the beginnings of a section's first blocks, for a planner's summary."""
    w = Window.partitionBy("doc_id", "section_ix").orderBy("pos")
    first = placed.where("type <> 'heading'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= blocks)
    g = first.groupBy("doc_id", "section_ix").agg(F.sort_array(F.collect_list(F.struct("_n", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("t")))).alias("p"))
    return g.select("doc_id", "section_ix", F.substring(F.array_join(F.transform("p", lambda x: x["t"]), " "), 1, total).alias("preview"))


# How a block of each type is announced to an annotator, and a heading inside a topic.
TAGS = {"table": "[TABLE]\n", "code": "[CODE]\n", "image": "[IMAGE] filename: ", "list_item": "[LIST_ITEM] ", "note": "[NOTE] "}
HEADING_TAG = ("[SUBSECTION_TITLE level=", "] ")

#: Topics of one document whose prompts are made by one task.
TOPICS_TOGETHER = 500


def prompts(topic_rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(doc_id, topic_ix, prompt): the blocks of a topic as the tagged lines an annotator reads.

    With ``heads`` (doc_id, topic_ix, document, title, product, filename; the product may be null) the prompt begins with the titles of
    document and topic, the product, and the titles and files of the document's other topics. So the prompts of a document grow with
    the square of its topics: they are put together last, and nothing moves them.
    """
    head = F.concat(F.lit(HEADING_TAG[0]), F.col("level").cast("string"), F.lit(HEADING_TAG[1]))
    tag = F.when(F.col("type") == "heading", head)
    for kind, text in TAGS.items():
        tag = tag.when(F.col("type") == kind, text)
    line = F.concat(tag.otherwise("[PARAGRAPH] "), F.coalesce("text", F.lit("")), F.lit("\n"))
    g = topic_rows.groupBy("doc_id", "topic_ix").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))).alias("p"))
    blocks = g.select("doc_id", "topic_ix", F.array_join(F.transform("p", lambda x: x["l"]), "").alias("prompt"))
    if heads is None:
        return blocks
    told, kept = told_topics(heads)
    x = blocks.join(kept, ["doc_id", "topic_ix"]).withColumn("_part", F.floor(F.col("topic_ix") / TOPICS_TOGETHER)).join(told, ["doc_id", "_part"], "left")

    def put(told: Column) -> Column:
        def stretches(kept: str) -> Column:
            return F.transform(kept, lambda k: F.substring(told, k["start"] + 1, k["end"] - k["start"]).cast("string"))

        others = F.size("titles") > 0
        return F.concat_ws(
            "", "head", F.when(others, "Other topics: "), stretches("titles"), F.when(others, "\n"),
            F.when(F.size("files") > 0, "Files of other topics:\n"), stretches("files"), F.lit("\nBlocks:\n"), "prompt",
        )

    # the one element of an array, so that the bytes are taken once and not again for each stretch
    return x.select("doc_id", "topic_ix", F.transform(F.array(F.col("told").cast("binary")), put)[0].alias("prompt"))


def told_topics(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What prompts tell of the topics of a document: its text, once for TOPICS_TOGETHER topics, and what each topic takes of it.

    First (doc_id, _part, told): all titles, each after ", ", and behind them the lines of all files. Second (doc_id, topic_ix, head,
    titles, files): the lines on the topic itself, and the stretches of bytes of ``told`` without topics of the same title. Topics of one
    title in succession are left out as one, so a topic has fewer stretches than there are topics in them.
    """
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("topic_ix")
    same = Window.partitionBy("doc_id", "title").orderBy("topic_ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def line(name: str, value: str) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")

    file = F.when(F.col("filename") != "", F.concat(F.lit("  "), "title", F.lit(" = "), "filename", F.lit("\n")))
    head = F.concat(line("Document", "document"), line("Topic", "title"), line("Product", "product"))
    x = heads.select("doc_id", "topic_ix", "title", head.alias("head"), F.coalesce(F.concat(F.lit(", "), "title"), F.lit("")).alias("_t"), F.coalesce(file, F.lit("")).alias("_f"))

    every = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("topic_ix", "_t", "_f"))).alias("e"))
    text = F.concat(F.array_join("e._t", ""), F.array_join("e._f", ""))
    # a sort-merge join gives out one long text after the other; explode, or a hash join of the parts, would hold all of a document's at once
    parts = x.select("doc_id", F.floor(F.col("topic_ix") / TOPICS_TOGETHER).alias("_part")).distinct()
    told = parts.join(every.select("doc_id", text.alias("told")).hint("merge"), "doc_id")

    first, last = ~F.col("title").eqNullSafe(F.lag("title").over(order)), ~F.col("title").eqNullSafe(F.lead("title").over(order))
    x = x.select("doc_id", "topic_ix", "title", "head", first.alias("_first"), last.alias("_last"), *(e for c in ("_t", "_f") for e in (F.octet_length(c).alias(f"{c}n"), F.sum(F.octet_length(c)).over(order).alias(f"{c}to"), F.sum(F.octet_length(c)).over(doc).alias(f"{c}all"))))

    def ends(c: str) -> list[Column]:
        return [F.collect_list(F.when(F.col("_first"), F.col(f"{c}to") - F.col(f"{c}n"))).over(same).alias(f"{c}from"), F.collect_list(F.when(F.col("_last"), F.col(f"{c}to"))).over(same).alias(f"{c}upto")]

    x = x.select("*", *ends("_t"), *ends("_f"))

    def between(c: str, at: Column, skip: int) -> Column:
        """The stretches between a topic's own; ``skip``: bytes of the first one that are left out."""
        pairs = F.zip_with(F.concat(F.array(F.lit(0).cast("bigint")), f"{c}upto"), F.concat(f"{c}from", F.array(f"{c}all")), lambda a, z: F.struct((at + a).cast("int").alias("start"), (at + z).cast("int").alias("end")))
        some = F.filter(pairs, lambda k: k["start"] < k["end"])
        some = F.transform(some, lambda k, i: F.struct((k["start"] + F.when(i == 0, skip).otherwise(0)).alias("start"), k["end"].alias("end")))
        return F.when(F.col("title").isNotNull(), some)

    return told, x.select("doc_id", "topic_ix", "head", between("_t", F.lit(0), 2).alias("titles"), between("_f", F.col("_tall"), 0).alias("files"))
