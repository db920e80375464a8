"""Markdown text to typed blocks with windows instead of a line loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import SPACE, split_lines, strip
from strataloom.plans.checkpoints import cut
from strataloom.plans.running import STRETCH, numbered, running_total


def markdown_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of each text."""
    return docs.where(F.col(text).isNotNull()).select(doc_id, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


#: Fences and the lines that end whatever runs before them are counted in one number: the fences above these bits.
_COUNT_BITS = 40


def markdown_blocks(lines: DataFrame, doc_id: str = "doc_id", order: str = "line_no", stretch: int = STRETCH) -> DataFrame:
    """(doc_id, block_ix, type, text, level) of Markdown lines in order.

    Fences pair off; the lines between them are one code block, also if there are none, and what follows an unpaired
    last fence is dropped. Headings and list items are one block per line. A line with two pipes starts a table that
    takes in all following lines that start with a pipe. Everything else joins into paragraphs up to a blank line or a
    line that starts like a block. A document whose lines are all blank has no blocks.

    Blank lines and fences end everything but code. They are counted in stretches of ``order``, and what is between two of them is
    told apart by itself, so that no task holds a whole document; code is gathered by its fence.
    """
    s = strip(F.col("line"))
    df = lines.select(doc_id, order, "line", s.alias("s"))
    df = df.withColumn("fence", F.startswith("s", F.lit("```")))
    ends = (F.col("fence") | (F.col("s") == "")).cast("bigint")
    df = running_total(df, doc_id, order, F.col("fence").cast("bigint") * (1 << _COUNT_BITS) + ends, "_n", stretch)
    df = df.withColumn("fences", F.shiftright("_n", _COUNT_BITS) - F.col("fence").cast("int")).withColumn("part", F.col("_n").bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)))
    df = df.withColumn("inside", (F.col("fences") % 2 == 1) & ~F.col("fence"))
    code = df.where("fences % 2 = 1").groupBy(doc_id, "fences").agg(
        F.min("part").alias("part"), F.min(order).alias("first"), F.max("fence").alias("closed"), F.sort_array(F.collect_list(F.when(F.col("inside"), F.struct(order, F.col("line").alias("t"))))).alias("parts"),
    )
    code = code.where("closed").select(doc_id, "part", "first", F.lit("code").alias("type"), F.lit(0).alias("level"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("text"))
    kind = (
        F.when(F.col("s").rlike(f"^#{{1,6}}[{SPACE}]+."), "H")
        .when(F.col("s").rlike(f"^(?:[-*+]|[0-9]+\\.)[{SPACE}]+."), "L")
        .when(F.col("s").rlike(r"^\|.*\|"), "T")
        .when(F.startswith("s", F.lit("|")), "S")
        .when(F.col("s").rlike(r"^[#*+-]"), "X")
        .otherwise("P")
    )
    run = Window.partitionBy(doc_id, "part").orderBy(order)
    df = df.where("not fence and not inside and s <> ''").select(doc_id, "part", order, "s", kind.alias("kind"))
    df = df.withColumn("piped", F.col("kind").isin("T", "S"))
    df = df.withColumn("pipes", F.sum((F.col("piped") & ~F.coalesce(F.lag("piped").over(run), F.lit(False))).cast("int")).over(run))
    table = F.max(F.when(F.col("kind") == "T", 1).otherwise(0)).over(Window.partitionBy(doc_id, "part", "piped", "pipes").orderBy(order)) == 1
    df = df.withColumn("type", F.when(F.col("kind") == "H", "heading").when(F.col("kind") == "L", "list_item").when(F.col("piped") & table, "table").otherwise("paragraph"))
    last = F.lag("type").over(run)
    goes_on = ((F.col("type") == "table") | ((F.col("type") == "paragraph") & (F.col("kind") == "P"))) & last.eqNullSafe(F.col("type"))
    df = df.withColumn("block", F.sum((~goes_on).cast("int")).over(run))
    said = F.when(F.col("kind") == "H", F.regexp_replace("s", f"^#+[{SPACE}]+", "")).when(F.col("kind") == "L", F.regexp_replace("s", f"^(?:[-*+]|[0-9]+\\.)[{SPACE}]+", "")).otherwise(F.col("s"))
    level = F.when(F.col("kind") == "H", F.length(F.regexp_extract("s", "^(#+)", 1))).otherwise(0)
    plain = df.select(doc_id, "part", "block", "type", order, said.alias("t"), level.alias("level")).groupBy(doc_id, "part", "block", "type").agg(
        F.min(order).alias("first"), F.max("level").alias("level"), F.sort_array(F.collect_list(F.struct(order, "t"))).alias("parts"),
    )
    texts = F.transform("parts", lambda p: p["t"])
    plain = plain.select(doc_id, "part", "first", "type", "level", F.when(F.col("type") == "paragraph", F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n")).alias("text"))
    blocks = cut(plain.unionByName(code))  # read twice to be numbered
    return numbered(blocks, doc_id, "part", ["first"], "block_ix").select(doc_id, "block_ix", "type", "text", F.col("level").cast("int").alias("level"))


def render_blocks(block: DataFrame) -> DataFrame:
    """(doc_id, pos, part, line): blocks as Markdown lines, each block followed by a blank one.

    Headings get # signs, list items a dash, code fences, tables pipes (from a JSON grid, or as they are); line ends
    inside other texts become blanks. Null texts give the blank line only.
    """
    flat = strip(F.regexp_replace("text", f"[{SPACE}]+", " "))
    grid = F.from_json("text", "array<array<string>>")
    piped = F.transform(grid, lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |")))
    lines = (
        F.when(F.col("text").isNull(), F.array(F.lit("")))
        .when(F.col("type") == "heading", F.array(F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))), F.lit(" "), flat), F.lit("")))
        .when(F.col("type") == "list_item", F.array(F.concat(F.lit("- "), flat), F.lit("")))
        .when(F.col("type") == "code", F.concat(F.array(F.lit("```")), F.split("text", "\n", -1), F.array(F.lit("```"), F.lit(""))))
        .when((F.col("type") == "table") & F.startswith("text", F.lit("[[")) & grid.isNotNull(), F.concat(piped, F.array(F.lit(""))))
        .when(F.col("type") == "table", F.concat(F.split("text", "\n", -1), F.array(F.lit(""))))
        .otherwise(F.array(flat, F.lit("")))
    )
    return block.select("doc_id", "pos", F.posexplode(lines).alias("part", "line"))
