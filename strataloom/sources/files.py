"""Files as rows: discovery, decoders behind an interface, logs, replies of annotators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import safe_upload_name, strip_fences

WORDS = "path string, page int, word_ix int, text string, x0 double, x1 double, top double, bottom double, fontname string, size double"
PAGES = "path string, page int, text string"
TABLES = "path string, page int, table_ix int, x0 double, top double, x1 double, bottom double, cells array<array<string>>"
IMAGES = "path string, page int, img_ix int, name string, width int, bytes bigint"


class Decoder(Protocol):
    """Turns the bytes of one file into rows; a class with these methods can be given to ``decode``."""

    def words(self, path: str, content: bytes) -> Iterator[tuple]: ...

    def pages(self, path: str, content: bytes) -> Iterator[tuple]: ...

    def tables(self, path: str, content: bytes) -> Iterator[tuple]: ...

    def images(self, path: str, content: bytes) -> Iterator[tuple]: ...


class DecoderMissing(RuntimeError):
    """No decoder is installed for the format."""


def discover(spark: SparkSession, folder: str, ending: str = ".pdf") -> DataFrame:
    """(path, length, modificationTime) of all files under ``folder`` with the ending in any letter case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.endswith(F.lower("path"), F.lit(ending))).select("path", "length", "modificationTime")


def sample(spark: SparkSession, folder: str, ending: str = ".pdf") -> DataFrame:
    """(path, content) of the first file by name under ``folder``: what is converted where nothing was handed in."""
    first = discover(spark, folder, ending).agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        raise FileNotFoundError(f"no {ending} file under {folder}")
    return spark.read.format("binaryFile").load(first).select("path", "content")


def decode(spark: SparkSession, folder: str, decoder: Decoder | None, what: str = "words", ending: str = ".pdf") -> DataFrame:
    """Rows of all files by a decoder; bytes go from the scan to the decoder within one task."""
    if decoder is None:
        raise DecoderMissing(f"give a decoder for {ending} files; none is installed")
    schema = {"words": WORDS, "pages": PAGES, "tables": TABLES, "images": IMAGES}[what]
    columns = [c.split()[0] for c in schema.replace("array<array<string>>", "x").split(", ")]
    read: Callable = getattr(decoder, what)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.endswith(F.lower("path"), F.lit(ending))).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [row for path, content in zip(pdf["path"], pdf["content"], strict=True) for row in read(path, content)]
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, schema)


def log_results(logs: DataFrame, text: str = "text") -> DataFrame:
    """Logs with ``result`` (PASS, FAIL, N/A, or ? if none is named) and ``errors``, the number of lines marked as errors."""
    found = F.regexp_extract(text, r"VALIDATION:\s+(PASS|FAIL|N/A)", 1)
    return logs.withColumn("result", F.when(found == "", "?").otherwise(found)).withColumn("errors", F.regexp_count(text, F.lit(r"(?m)^  ✗ ")))


REPLY = "topic_type string, body_xml string, shortdesc string, keywords array<string>, reasoning string"


def _string_field(text: Column, name: str) -> Column:
    """The string value after a field's name, escapes read as JSON does; null if there is none."""
    literal = F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*("(?:[^"\\]|\\.)*")', 1), F.lit(""))
    return F.from_json(F.concat(F.lit('{"v":'), literal, F.lit("}")), "v string")["v"]


def _body_in(text: Column) -> Column:
    """The first whole body element of any topic type in a text, quotes still escaped or not; null if there is none."""
    found = []
    for name in BODIES:
        start = F.locate(f"<{name}", text)
        length = F.locate(f"</{name}>", F.substring(text, start, F.length(text))) + len(name) + 2
        found.append(F.when((start > 0) & (length > len(name) + 2), F.struct(start.alias("at"), F.substring(text, start, length).alias("body"))))
    return F.array_min(F.array_compact(F.array(*found)))["body"]


BODIES = ("conbody", "taskbody", "refbody")
TYPES = ("concept", "task", "reference")
UNREAD = '<conbody class="- topic/body  concept/conbody "><p class="- topic/p ">No text could be read from the reply.</p></conbody>'


def salvage_reply(reply: Column, title: Column) -> Column:
    """The fields of an annotator's reply, by the first reading that has a type or a body.

    Read are: the reply as JSON, what stands between its outermost braces as JSON, its fields one by one, and at last a stub with the title.
    """
    text = strip_fences(reply)
    braces = F.substring(text, F.locate("{", text), F.length(text) - F.locate("}", F.reverse(text)) - F.locate("{", text) + 2)
    fields = {f: _string_field(text, f) for f in ("topic_type", "shortdesc", "reasoning")}
    words = F.from_json(F.nullif(F.regexp_extract(text, r'"keywords"\s*:\s*(\[[^\]]*\])', 1), F.lit("")), "array<string>")
    none = F.array().cast("array<string>")
    kind = F.when(fields["topic_type"].isin(*TYPES), fields["topic_type"])
    body = _body_in(text)
    pieces = F.struct(kind.alias("topic_type"), body.alias("body_xml"), F.coalesce(fields["shortdesc"], F.lit("")).alias("shortdesc"), F.coalesce(words, none).alias("keywords"), F.coalesce(fields["reasoning"], F.lit("read field by field")).alias("reasoning"))
    stub = F.struct(F.lit("concept").alias("topic_type"), F.lit(UNREAD).alias("body_xml"), title.alias("shortdesc"), none.alias("keywords"), F.lit("reply not readable").alias("reasoning"))
    readings = [F.when(r["topic_type"].isNotNull() | r["body_xml"].isNotNull(), r) for r in (F.from_json(text, REPLY), F.from_json(braces, REPLY))]
    return F.coalesce(*readings, F.when(kind.isNotNull() & body.isNotNull(), pieces), stub)


PLAN = "array<struct<topic_title: string, topic_type: string, section_indices: array<int>, reasoning: string>>"


def salvage_plan(reply: Column, sections: Column | None = None) -> Column:
    """The planned topics of a reply, from the whole text or what stands between its outermost brackets.

    Where neither can be read: one topic for each of ``sections`` (array of structs with ``title`` and ``topic_type``), null without them.
    """
    text = strip_fences(reply)
    brackets = F.substring(text, F.locate("[", text), F.length(text) - F.locate("]", F.reverse(text)) - F.locate("[", text) + 2)
    read = F.coalesce(F.from_json(text, PLAN), F.from_json(brackets, PLAN))
    if sections is None:
        return read
    each = F.transform(sections, lambda x, i: F.struct(x["title"].alias("topic_title"), x["topic_type"].alias("topic_type"), F.array(i).alias("section_indices"), F.lit("fallback").alias("reasoning")))
    return F.coalesce(read, each)


def log_summary(logs: DataFrame, name: str, text: str = "text", code: str = "code") -> DataFrame:
    """(name, result, errors, passed, line): what a run's log says; passed takes a PASS and return code 0."""
    got = log_results(logs, text)
    passed = (F.col("result") == "PASS") & (F.col(code) == 0)
    line = F.concat_ws("\t", F.when(passed, "PASS").otherwise("FAIL"), name, "result", F.concat(F.lit("errs="), F.col("errors").cast("string")))
    return got.select(name, "result", "errors", passed.alias("passed"), line.alias("line"))


def uploads(spark: SparkSession, folder: str, ending: str = ".pdf") -> DataFrame:
    """A stream of the files that are handed in to ``folder``: (path, name, content, modificationTime).

    ``name`` is safe to store under: no folders, and told apart from equal names by the path and time it came with.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*").load(folder).where(F.endswith(F.lower("path"), F.lit(ending)))
    return files.select("path", safe_upload_name(F.col("path"), F.concat("path", F.col("modificationTime").cast("string"))).alias("name"), "content", "modificationTime")
