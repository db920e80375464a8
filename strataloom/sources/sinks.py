"""Sinks: topic files, maps, caches, bundles and reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_topics(files: DataFrame, folder: str) -> None:
    """Topic files as parquet by document; clashing names keep all rows, told apart by topic_ix."""
    files.write.mode("overwrite").parquet(folder)


def write_texts(files: DataFrame, folder: str, name: str = "filename", text: str = "xml") -> DataFrame:
    """The texts as files below ``folder``/doc_id=.../name=.../, on any file system that Spark writes to; returns what is stored.

    Of rows with one name in a document, the last by topic_ix is written. Names keep no folders; null texts are empty files.
    """
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    last = files.select("doc_id", base.alias("name"), "topic_ix", F.coalesce(text, F.lit("")).alias("value")).groupBy("doc_id", "name").agg(F.max_by("value", "topic_ix").alias("value"))
    last.repartition("doc_id", "name").write.mode("overwrite").partitionBy("doc_id", "name").text(folder)
    return files.sparkSession.read.option("wholetext", True).text(folder)


def append_images(images: DataFrame, stored: DataFrame | None, folder: str, endings: tuple[str, ...] = (".png", ".jpg", ".jpeg")) -> DataFrame:
    """New images (doc_id, name, content) with one of the ``endings`` appended to ``folder``; those stored before under a name are left alone."""
    fresh = images.where(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")).select("doc_id", "name", "content").dropDuplicates(["doc_id", "name"])
    if stored is not None:
        fresh = fresh.join(stored.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti")
    fresh.write.mode("append").parquet(folder)
    return fresh


def append_cache(results: DataFrame, cache: DataFrame | None, folder: str, key: str = "key") -> DataFrame:
    """New results appended to a cache folder; returns what was new. Keys already cached are left alone."""
    fresh = results.dropDuplicates([key])
    if cache is not None:
        fresh = fresh.join(cache.select(key).distinct(), key, "left_anti")
    fresh.write.mode("append").parquet(folder)
    return fresh


def write_summary(lines: DataFrame, folder: str) -> None:
    """Tab-separated summary lines."""
    lines.write.mode("overwrite").option("sep", "\t").csv(folder)


def batch_report(runs: DataFrame) -> DataFrame:
    """(client, json): a line per run, and the totals under a null client; no task holds all runs."""
    entry = runs.select("client_id", F.to_json(F.struct(F.col("client_id").alias("client"), "stages", "done", "failed")).alias("json"))
    totals = runs.agg(F.count("*").alias("total"), F.count_if(F.col("failed") == 0).alias("passed"), F.round(F.sum("seconds"), 2).alias("seconds"))
    return entry.unionAll(totals.select(F.lit(None).cast("string"), F.to_json(F.struct("total", "passed", "seconds")))).withColumnRenamed("client_id", "client")


def write_batch_report(runs: DataFrame, folder: str) -> None:
    """The lines of ``batch_report`` as text files of JSON lines."""
    batch_report(runs).select("json").write.mode("overwrite").text(folder)


#: Topics of one volume of a bundle, which bounds what one task puts together.
VOLUME_TOPICS = 1_000
_EPOCH = (1980, 1, 1, 0, 0, 0)


def bundles(files: DataFrame, name: str = "filename", text: str = "xml", volume_topics: int = VOLUME_TOPICS) -> DataFrame:
    """(doc_id, volume, content): zip files of the topic files of each document, names in order, so many topics each.

    The bytes depend on names and texts only. Of rows with one name in a volume, the last by topic_ix is kept; null texts are empty.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        last = {r.name: r.text for r in pdf.sort_values("topic_ix").itertuples(index=False)}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in sorted(last):
                z.writestr(zipfile.ZipInfo(n, _EPOCH), last[n] or "")
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "volume": [pdf["volume"].iloc[0]], "content": [out.getvalue()]})

    volume = F.floor(F.col("topic_ix") / volume_topics).cast("int")
    rows = files.select("doc_id", volume.alias("volume"), "topic_ix", F.col(name).alias("name"), F.col(text).alias("text"))
    return rows.groupBy("doc_id", "volume").applyInPandas(pack, "doc_id bigint, volume int, content binary")


def unbundle(packed: DataFrame) -> DataFrame:
    """(doc_id, volume, name, text) of the files in bundles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, volume, content in pdf.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(doc_id, volume, n, z.read(n).decode("utf-8")) for n in z.namelist()]
            yield pd.DataFrame(rows, columns=["doc_id", "volume", "name", "text"])

    return packed.select("doc_id", "volume", "content").mapInPandas(run, "doc_id bigint, volume int, name string, text string")
