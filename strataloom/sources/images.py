"""Images kept within limits of width and size, by a codec that plugs in; without one, images stay as they are."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.runs import IMAGE_BYTES, IMAGE_WIDTH, QUALITIES
from strataloom.sources.files import DecoderMissing

CAPPED = "doc_id bigint, name string, content binary, changed boolean"


class Codec(Protocol):
    """What is asked of an imaging library; every method may raise on content that it cannot read."""

    def width(self, content: bytes) -> int: ...

    def narrow(self, content: bytes, width: int) -> bytes: ...

    def jpeg(self, content: bytes, quality: int) -> bytes:
        """Without transparency, at the quality given."""
        ...


def capped(name: str, content: bytes, codec: Codec, width: int, size: int) -> tuple[str, bytes]:
    """Name and content within the limits, as far as the qualities go; the best is the first that keeps the size, else the smallest."""
    if codec.width(content) > width:
        content = codec.narrow(content, width)
    if len(content) <= size:
        return name, content
    smallest = content
    for quality in QUALITIES:
        smallest = codec.jpeg(content, quality)
        if len(smallest) <= size:
            break
    stem, _, ending = name.rpartition(".")
    return (name if ending.lower() in ("jpg", "jpeg") else f"{stem}.jpg"), smallest


def cap_images(images: DataFrame, codec: Codec | None, width: int = IMAGE_WIDTH, size: int = IMAGE_BYTES) -> DataFrame:
    """(doc_id, name, content, changed) of images (doc_id, name, content); what the codec cannot read stays as it is."""
    if codec is None:
        raise DecoderMissing("give a codec for images; none is installed")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, name, content in pdf.itertuples(index=False):
                try:
                    new = capped(name, bytes(content), codec, width, size)
                except Exception:  # any fault of a single image leaves it alone
                    new = (name, content)
                rows.append((doc_id, *new, new[1] != content))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "content", "changed"])

    return images.select(F.col("doc_id").cast("bigint"), "name", "content").mapInPandas(run, CAPPED)
