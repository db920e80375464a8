"""Where planning, classification and repair plug in; the rules of this library are the default."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import cache_key, strip_fences, strip_preamble
from strataloom.operators import emit, sections
from strataloom.operators.xmltree import fix_content_model, well_formed
from strataloom.plans.checkpoints import cut
from strataloom.sources.files import salvage_reply

#: Statuses after which a call is tried again, and how often.
RETRY = frozenset({403, 408, 425, 429, 500, 502, 503, 504})
TRIES = 3
#: Seconds between the calls of one task.
GAP = 0.1


class Annotator(Protocol):
    """Answers prompts: called once per partition with an iterator, so that clients and limits are per task."""

    def answer(self, prompts: Iterator[str]) -> Iterator[str]: ...


class CallError(RuntimeError):
    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


class Calling:
    """An annotator around a function from prompt to reply, with spacing and retries; every try starts afresh."""

    def __init__(self, call: Callable[[str], str], gap: float = GAP, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep):
        self.call, self.gap, self.tries, self.sleep = call, gap, tries, sleep

    def answer(self, prompts: Iterator[str]) -> Iterator[str]:
        for n, prompt in enumerate(prompts):
            if n:
                self.sleep(self.gap)
            for attempt in range(self.tries):
                try:
                    yield self.call(prompt)
                    break
                except CallError as e:
                    if e.status not in RETRY or attempt == self.tries - 1:
                        raise
                    wait = min(max(e.wait, 1.0), 20.0) if e.wait else min(1.5**attempt, 20.0)
                    self.sleep(max(wait, 5.0) if e.status == 429 and not e.wait else wait)


def annotate(prompts: DataFrame, annotator: Annotator, system: str = "", cache: DataFrame | None = None) -> DataFrame:
    """(all columns, key, reply) of rows with ``prompt``; cached keys are not asked again."""
    keyed = prompts.withColumn("key", cache_key(F.lit(system), F.col("prompt")))
    schema = "key string, prompt string, reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(reply=list(annotator.answer(iter(pdf["prompt"]))))

    ask = keyed.select("key", "prompt").dropDuplicates(["key"])
    if cache is not None:
        ask = ask.join(cache.select("key").distinct(), "key", "left_anti")
    got = ask.mapInPandas(run, schema).select("key", "reply")
    if cache is not None:
        got = got.unionAll(cache.select("key", "reply").dropDuplicates(["key"]))
    return keyed.join(got, "key")


#: Times that a broken body is sent to be repaired.
REPAIRS = 2


def repair(topic: DataFrame, annotator: Annotator, body: str = "body_xml", tries: int = REPAIRS, system: str = "repair") -> DataFrame:
    """``topic`` with ``body`` repaired, and ``valid``, ``tries`` and ``error`` of each row.

    Bodies that are not well-formed go to the annotator with what is wrong, at most ``tries`` times; each reply loses its fences and is
    brought to the content model before it is looked at again, and the last one stays. What is broken then keeps an error. Only broken
    rows are asked for, each distinct body once, and each round is cut, so that no reply is asked for twice. Null bodies are valid.
    """
    keys = [c for c in topic.columns if c != body]
    x = cut(topic.select("*", F.coalesce(well_formed(F.col(body)), F.lit(True)).alias("valid"), F.lit(0).alias("tries")))
    done = [x.where("valid")]
    for n in range(1, tries + 1):
        ask = x.where("not valid").withColumn("prompt", F.concat(F.lit("Error: not well-formed\n\nXML to fix:\n"), body))
        got = annotate(ask, annotator, system).select(*keys, fix_content_model(strip_fences(F.col("reply"))).alias(body), F.lit(n).alias("tries"))
        x = cut(got.select(*topic.columns, well_formed(F.col(body)).alias("valid"), "tries"))
        done.append(x if n == tries else x.where("valid"))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.withColumn("error", F.when(~F.col("valid"), F.concat(F.lit("not well-formed after "), F.col("tries").cast("string"), F.lit(" repairs"))))


class PromptCache:
    """Names of long system prompts that a service keeps, by model and prompt, each until it expires; one per executor process."""

    def __init__(self, make: Callable[[str, str], str | None], seconds: float = 3600.0, margin: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.margin, self.clock = make, seconds, margin, clock
        self._names: dict[tuple[str, str], tuple[str, float]] = {}

    def name(self, model: str, system: str) -> str | None:
        """The name to refer to the prompt by; made anew where none is kept or it is about to expire, None where none can be made."""
        key = (model, hashlib.sha256(system.encode()).hexdigest())
        now = self.clock()
        held = self._names.get(key)
        if held and held[1] - self.margin > now:
            return held[0]
        made = self.make(model, system)
        if made is None:
            self._names.pop(key, None)
        else:
            self._names[key] = (made, now + self.seconds)
        return made


class Reader(Protocol):
    """Reads what a scanned file says, as Markdown; may raise."""

    def read(self, content: bytes) -> str: ...


def recognise(files: DataFrame, reader: Reader, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, text): the Markdown that a reader makes of scanned files; no text where it fails. Bytes stay in the task that reads them."""
    schema = f"{key} {files.schema[key].dataType.simpleString()}, text string"

    def one(data: bytes | None) -> str | None:
        try:
            return None if data is None else reader.read(bytes(data))
        except Exception:  # any failure of a single file leaves it without text
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "text": [one(c) for c in pdf[content]]})

    return files.select(key, content).mapInPandas(run, schema)


def classify(block: DataFrame, annotator: Annotator | None = None, cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, topic_ix, title, topic_type, body_xml, shortdesc, keywords) of all topics of block rows.

    Without an annotator the rules plan and write the topics; with one, its replies do, salvaged where broken.
    """
    placed, planned = sections.place_blocks(block)
    titles = sections.topics(planned).select("doc_id", "topic_ix", F.col("topic_title").alias("title"), "topic_type")
    rows = sections.topic_texts(block, placed, planned)
    if annotator is None:
        out = titles.join(emit.bodies(rows), ["doc_id", "topic_ix"])
        return out.select("doc_id", "topic_ix", "title", "topic_type", "body_xml", F.lit("").alias("shortdesc"), F.array().cast("array<string>").alias("keywords"))
    asked = annotate(sections.prompts(rows), annotator, cache=cache).join(titles.select("doc_id", "topic_ix", "title"), ["doc_id", "topic_ix"])
    got = asked.select("doc_id", "topic_ix", "title", salvage_reply(F.col("reply"), F.col("title")).alias("r"))
    return got.select("doc_id", "topic_ix", "title", "r.topic_type", strip_preamble(F.col("r.body_xml")).alias("body_xml"), "r.shortdesc", "r.keywords")
