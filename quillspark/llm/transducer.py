"""BPE as a streaming transducer, text to ids and ids back to text.

Null texts are empty; each row stands for itself, so repeated rows give repeated results, and a null doc_id is kept. A text
of any length is read by blocks. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import Decoder, Encoder, encoder
from .shared import by_bytes

#: Bytes of text encoded at once.
TEXT = 4 << 20


def streamed(machine: Encoder, text: str) -> tuple[int, str, str]:
    """What round_trip tells of a text, from ids that are decoded as they come and not kept."""
    count, sent, back, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(machine.merges)
    for ids in machine.stream(text):
        count += len(ids)
        sent.update(ids.astype("<u4"))
        back.update(decoder.feed(ids).encode())
    back.update(decoder.finish().encode())
    return count, sent.hexdigest(), back.hexdigest()


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids, and that of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(vocabulary)
        for batch in by_bytes(batches, TEXT):
            texts = [t or "" for t in batch["text"].to_pylist()]
            if len(texts) == 1:
                found = [streamed(machine, texts[0])]
            else:
                ids, at = machine.encode(texts)
                cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                found = [(j - i, hashlib.sha256(ids[i:j].astype("<u4")).hexdigest(), hashlib.sha256("".join(machine.decode(ids[i:j])).encode()).hexdigest()) for i, j in cut]
            numbers, sent, back = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(numbers, pa.int64()), pa.array(sent), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
