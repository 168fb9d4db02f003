"""Operator 10: byte-level BPE encoding and decoding with tiktoken.

The ranks come from a local file.  Long texts are cut at places where every
match of the split pattern must end, so each part is encoded by itself and
the ids of the parts, one after another, are those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that follows an ASCII letter, digit or full stop: no match of the
#: pattern goes on from there into white space, and none looks back.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _encode(enc: tiktoken.Encoding, text: str, size: int) -> np.ndarray:
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in parts(text, size)])


def encode(docs: DataFrame, *, path: str, pattern: str, text: str = "text", ids: str = "ids", part_chars: int = 1 << 16) -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids``: the token ids as little-endian unsigned 32-bit integers.

    A null text counts as empty (no ids).  Special tokens are ordinary text.
    An existing column ``ids`` is replaced.  ``path`` is the rank file's place
    on every executor.  Texts of more than ``part_chars`` characters are encoded
    in parts; a text without a safe cut is one part, however long.
    """
    return _coded(docs.drop(ids), text, ids, lambda value: _encode(encoding(path, pattern), value or "", part_chars).tobytes())


def decode(coded: DataFrame, *, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """All columns and ``data``: the raw bytes of the ids; null ids give no bytes."""

    def raw(value: bytes | None) -> bytes:
        return encoding(path, pattern).decode_bytes(np.frombuffer(value or b"", dtype="<u4").tolist())

    return _coded(coded.drop(data), ids, data, raw, keep=True)


def round_trip(docs: DataFrame, *, path: str, pattern: str, text: str = "text", part_chars: int = 1 << 16) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``ids`` and ``decoded`` beside the columns but the text."""

    def both(value: str | None) -> tuple[bytes, bytes]:
        enc = encoding(path, pattern)
        got = _encode(enc, value or "", part_chars)
        return got.tobytes(), enc.decode_bytes(got.tolist())

    return _coded(docs.drop("ids", "decoded"), text, ["ids", "decoded"], both)


def _coded(df: DataFrame, source: str, target, fn, keep: bool = False) -> DataFrame:
    names = [target] if isinstance(target, str) else target
    others = [c for c in df.columns if keep or c != source]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others] + [f"`{n}` binary" for n in names])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            at = batch.schema.get_field_index(source)
            for i in range(0, batch.num_rows, 512):
                few = batch.slice(i, 512)
                made = [fn(x) for x in few.column(at).to_pylist()]
                made = [made] if isinstance(target, str) else list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([few.column(few.schema.get_field_index(c)) for c in others] + [pa.array(m, pa.binary()) for m in made], names=[*others, *names])

    return df.mapInArrow(run, schema)


def digests(coded: DataFrame) -> DataFrame:
    """Number of ids and SHA-256 of ids and decoded bytes, in place of both."""
    return coded.select(
        *[c for c in coded.columns if c not in ("ids", "decoded")],
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
