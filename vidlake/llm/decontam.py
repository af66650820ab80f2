"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Text is lower-cased (A-Z) and every other ASCII character outside 0-9a-z is a
separator; bytes of 0x80 and above belong to words. The patterns are all
13-word windows of each item (the whole item if shorter), framed by
separators. A document is scanned once; match ends are mapped back to word
numbers and to byte offsets of the original text, which the normalisation
keeps one to one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

WINDOW = 13
#: Bytes of framed window text in one automaton; a larger benchmark is scanned in blocks of this size.
BLOCK_BYTES = 8_000_000
#: Share of hit words, as 1 / SHARE, from which a document is contaminated.
SHARE = 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(items: list[tuple], window: int = WINDOW) -> dict[str, tuple[int, list]]:
    """Framed window text -> (its words, the ids of the items that hold it)."""
    out: dict[str, tuple[int, list]] = {}
    for item_id, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            part = words[k : k + window]
            ids = out.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), []))[1]
            if item_id not in ids:
                ids.append(item_id)
    return out


@lru_cache(maxsize=2)
def _automaton(patterns: tuple) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, size, ids in patterns:
        found.add_word(text, (size, ids))
    found.make_automaton()
    return found


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """(first word, last word + 1) of every match, and the ids found."""
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ends: list[int] = []
    sizes: list[int] = []
    ids: set = set()
    for end, (size, items) in automaton.iter(text):
        ends.append(end)
        sizes.append(size)
        ids.update(items)
    if not ends:
        return [], ids
    #: the separator after word w stands at after[w]
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = np.searchsorted(after, ends) + 1
    return list(zip((last - np.array(sizes)).tolist(), last.tolist(), strict=True)), ids


def word_spans(text: str) -> list[tuple[int, int]]:
    """Byte offsets, in the original UTF-8 text, of its words."""
    keep = np.frombuffer(text.encode().translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.r_[False, keep, False].astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``, narrow over documents.

    Adds n_words, n_hit, n_items, items_sha256, contaminated and ``spans``
    (array of struct(start, stop): byte offsets of hit stretches in the
    original text). Null texts and items have no words; an empty benchmark hits
    nothing; null item ids are skipped. The benchmark goes out in automata of
    at most ``block_bytes``; each further block adds one more narrow pass that
    merges into the marks of the blocks before it.
    """
    spark = docs.sparkSession
    blocks: list[list] = [[]]
    held = 0
    for text, (size, ids) in windows([(r[0], r[1]) for r in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator()], window).items():
        if held + len(text) > block_bytes and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((text, size, tuple(ids)))
        held += len(text)
    source = docs.select(*keep, docs["text"].alias("_text"), F.lit(None).cast("binary").alias("_marks"), F.lit(None).cast("array<string>").alias("_ids"))
    schema, n = source.schema, len(keep)
    for block in blocks:
        source = source.mapInArrow(_pass(spark.sparkContext.broadcast(tuple(block)), n), schema)
    out = T.StructType(
        schema.fields[:n]
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
        ]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, marks, ids in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True):
                hit = np.frombuffer(marks or b"", np.int64).reshape(-1, 2)
                n_words, n_hit = int(hit[0, 0]), int((hit[1:, 1] - hit[1:, 0]).sum())
                names = sorted(ids or [])
                spans = []
                if n_hit:
                    at = word_spans(text)
                    spans = [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in hit[1:].tolist()]
                for col, value in zip(cols, (n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and SHARE * n_hit >= n_words, spans), strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=out.names)

    return source.mapInArrow(finish, out)


def _pass(block, n: int):
    """Merge one automaton's matches into the marks: pairs of (n_words, 0), then disjoint word ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block.value) if block.value else None
        for whole in batches:
            for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                marks_out, ids_out = [], []
                for text, marks, ids in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True):
                    words = words_of(text)
                    spans, found = scan(automaton, words) if automaton and words else ([], set())
                    old = np.frombuffer(marks or b"", np.int64).reshape(-1, 2)[1:].tolist()
                    merged: list[list[int]] = []
                    for a, b in sorted([*map(tuple, old), *spans]):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    marks_out.append(np.array([[len(words), 0], *merged], np.int64).tobytes())
                    ids_out.append(sorted({*(ids or []), *map(str, found)}))
                yield pa.RecordBatch.from_arrays(batch.columns[: n + 1] + [pa.array(marks_out, pa.binary()), pa.array(ids_out, pa.list_(pa.string()))], schema=batch.schema)

    return run


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.drop("spans")
