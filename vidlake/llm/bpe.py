"""Byte-level BPE as a monoid: encode halves, join them by re-encoding around the seam.

Why a join is exact: the pre-tokenising pattern never lets white space follow
another character inside one piece, so every place where a white-space
character follows a non-white-space one is a piece boundary in any text that
contains both characters. Between two such places the pieces, hence the
tokens, depend on nothing outside. A join therefore re-encodes only the text
from the last such place left of the seam to the first one right of it; the
window grows to a whole half where a half has none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

LEAF_CHARS = 8192
#: White space by the pattern's engine is a subset of Python's, minus the four separators below.
_SEAM = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray, list[bytes]]:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    tokens = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    return (
        tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={}),
        np.array([len(t) for t in tokens], np.int64),
        tokens,
    )


def _last_seam(text: str, step: int = 256) -> int:
    """The last provable boundary, or 0; looks at growing suffixes."""
    while True:
        lo = max(0, len(text) - step)
        found = [m.start() for m in _SEAM.finditer(text, lo)]
        if found:
            return found[-1]
        if lo == 0:
            return 0
        step *= 4


def _first_seam(text: str) -> int:
    found = _SEAM.search(text)
    return found.start() if found else len(text)


def _split_at(sizes: np.ndarray, ids: np.ndarray, n_bytes: int, from_end: bool) -> int:
    """How many tokens make up exactly n_bytes at one end."""
    if n_bytes == 0:
        return 0
    step = min(len(ids), n_bytes)
    part = ids[len(ids) - step :][::-1] if from_end else ids[:step]
    k = int(np.searchsorted(np.cumsum(sizes[part]), n_bytes)) + 1
    if int(sizes[part[:k]].sum()) != n_bytes:
        raise AssertionError("a provable boundary fell inside a token")
    return k


class TreeCodec:
    """Encode and decode by tree reduction; ``leaf`` characters are encoded at once."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF_CHARS):
        self.coder, self.sizes, self.tokens = _encoding(ranks, pattern)
        self.leaf = leaf

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._plain(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        a, b = _last_seam(left), _first_seam(right)
        drop = _split_at(self.sizes, left_ids, len(left[a:].encode()), True)
        skip = _split_at(self.sizes, right_ids, len(right[:b].encode()), False)
        return np.concatenate([left_ids[: len(left_ids) - drop], self._plain(left[a:] + right[:b]), right_ids[skip:]])

    def decode(self, ids: np.ndarray) -> bytes:
        """Leaves of tokens become bytes, and neighbours concatenate level by level."""
        tokens = self.tokens
        parts = [b"".join([tokens[i] for i in ids[k : k + self.leaf].tolist()]) for k in range(0, len(ids), self.leaf)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0]


def encode_decode(docs: DataFrame, ranks: bytes, keep: list[str], full: bool = False, leaf: int = LEAF_CHARS) -> DataFrame:
    """Encode ``text`` of every row, decode the ids again; one narrow pass, no shuffle.

    ``keep`` names the columns to carry. With ``full`` the ids (array<int>) and
    the decoded text come too. Null texts are empty: no ids, digests of nothing.
    Digests: ``ids_sha256`` over comma-joined decimal ids, ``decoded_sha256``
    over the decoded bytes.
    """
    from pyspark.sql import types as T

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        added += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    source = docs.select(*keep, docs["text"].alias("_text"))
    schema = T.StructType(source.schema.fields[:-1] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(ranks, leaf=leaf)
        for whole in batches:
            for batch in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                counts, ids_hex, out_hex, ids_all, texts = [], [], [], [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    ids = codec.encode(text or "")
                    back = codec.decode(ids)
                    counts.append(len(ids))
                    ids_hex.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                    out_hex.append(hashlib.sha256(back).hexdigest())
                    if full:
                        ids_all.append(ids.astype(np.int32))
                        texts.append(back.decode())
                columns = batch.columns[:-1] + [pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(out_hex)]
                if full:
                    columns += [pa.array(ids_all, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def read_ranks(path: str | None = None) -> bytes:
    """The rank file, read on the driver and shipped with the closure (under 1 MB)."""
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), read_ranks(), ["doc_id"])
