"""Edits in free text: the JSON array of edit objects that a reply holds among other words."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Longer replies aren't read; None reads all.
LONGEST = 256 * 1024
FENCE = "```"
_DECODER = json.JSONDecoder()


def edits_of(reply: str | None, prompt: str | None = None, key: str = "param", longest: int | None = LONGEST) -> list[dict] | None:
    """The objects of the first JSON array in a reply of which one has the key, or None.

    Code fences are taken out, and a prompt that the reply repeats goes with all before it, so its examples aren't taken for
    edits. Every bracket is tried as a start where it stands, strings and nested brackets read as JSON; a start that doesn't
    parse, nests too deeply or gives an array of other things is passed over. An object around the array is no obstacle.
    """
    if not reply or not reply.strip() or (longest is not None and len(reply) > longest):
        return None
    text = reply.replace(FENCE, "")
    if prompt:
        asked = prompt.replace(FENCE, "")
        at = text.find(asked) if asked else -1
        text = text[at + len(asked) :] if at >= 0 else text
    at = text.find("[")
    while at >= 0:
        try:
            found, _ = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, list) and any(isinstance(e, dict) and key in e for e in found):
            return [e for e in found if isinstance(e, dict)]
        at = text.find("[", at + 1)
    return None


def extracted(replies: DataFrame, text: str, prompt: str | None = None, key: str = "param", name: str = "edits", longest: int | None = LONGEST) -> DataFrame:
    """Add to replies the edits of a text column, each as JSON with sorted keys, null where there are none; prompt names a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            asked = batch.column(batch.schema.get_field_index(prompt)).to_pylist() if prompt else [None] * len(texts)
            found = [edits_of(t, p, key, longest) for t, p in zip(texts, asked, strict=True)]
            values = [None if f is None else [json.dumps(e, sort_keys=True, ensure_ascii=False) for e in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.string()))], [*batch.schema.names, name])

    return replies.mapInArrow(run, StructType([*replies.schema.fields, StructField(name, ArrayType(StringType()))]))
