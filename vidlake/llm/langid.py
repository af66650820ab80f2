"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile ranks the most frequent letter n-grams (1 to 3, words framed by
``_``) of a language's training texts. A document's own profile is compared
with each: every n-gram adds the difference of its ranks, or the profile
length where the language lacks it; the smallest total wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, read_table

PROFILE = 400
#: Training texts of each language, at most (in expectation): the profile's fit is on this bounded sample.
SAMPLE_PER_LANG = 2000
#: Characters of a text counted at a time.
BLOCK_CHARS = 1 << 20
_EDGE = ord("_") + 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself plus one for letters, the word edge for everything else."""
    alpha = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return np.where(alpha, np.arange(1, 0x110001), _EDGE).astype(np.int64)


def gram_text(code: int) -> str:
    """The n-gram of a code: three fields of 21 bits, code point plus one or 0, so codes sort as their strings."""
    return "".join(chr(c - 1) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a whole text's lower-cased words, framed by ``_``."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.r_[_EDGE, _letters()[points], _EDGE]
    line = line[np.r_[True, (line[1:] != _EDGE) | (line[:-1] != _EDGE)]]
    parts = []
    for lo in range(0, max(1, len(line) - 1), BLOCK_CHARS):
        one = line[lo : lo + BLOCK_CHARS + 2]
        own = min(BLOCK_CHARS, len(line) - lo)
        single = one[:own] << 42
        pair = single[: len(one) - 1] + (one[1:][:own] << 21)
        triple = pair[: len(one) - 2] + one[2:][:own]
        parts.append(np.unique(np.concatenate([single[one[:own] != _EDGE], pair, triple[one[1:-1][: len(triple)] != _EDGE]]), return_counts=True))
    if len(parts) == 1:
        codes, counts = parts[0]
    else:
        codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Most frequent first; ties in code-point order."""
    if len(codes) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))[:size]]


def profiles(docs: DataFrame, sample: int = SAMPLE_PER_LANG, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages in ``docs`` (doc_id, text, lang; null langs are skipped).

    Rows are taken by a hash of their id so that a language gives about
    ``sample`` texts at most; their n-gram counts are summed in Spark.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    # a row a language, as many as the model itself holds on the driver
    found = known.groupBy("lang").count().collect()
    share = known.sparkSession.createDataFrame([(r["lang"], sample / r["count"]) for r in found], "lang string, share double")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(gram_counts(text))
                if sum(map(len, held.values())) >= 256:
                    yield from _sums(held)
            yield from _sums(held)

    sums = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    # size rows a language
    for row in sums.withColumn("rank", best).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def _sums(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    """The texts counted so far, added up by language."""
    for lang, each in held.items():
        codes, at = np.unique(np.concatenate([c for c, _ in each]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([n for _, n in each])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])
    held.clear()


def out_of_place(document: list[int], profile: dict[int, int], size: int) -> int:
    """The distance in its plain form."""
    return sum(abs(profile[g] - r) if g in profile else size for r, g in enumerate(document))


class Identifier:
    """Scores whole texts; distances are lookups in a table of ranks by language."""

    def __init__(self, langs: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(langs), size
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(langs[n], np.int64) for n in self.names)]))
        self.place = np.full((len(self.names), len(self.codes) + 1), size, np.int64)
        for k, name in enumerate(self.names):
            self.place[k, np.searchsorted(self.codes, langs[name])] = np.arange(len(langs[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - its distance / the largest possible); ('und', 0) without letters or languages."""
        document = ranked(*gram_counts(text), self.size)
        if not len(document) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, document), len(self.codes) - 1)
        place = self.place[:, np.where(self.codes[at] == document, at, len(self.codes))]
        far = np.where(place < self.size, np.abs(place - np.arange(len(document))), self.size).sum(axis=1)
        k = int(np.argmin(far))
        return self.names[k], max(0.0, 1.0 - float(far[k]) / (self.size * len(document)))


def identify(docs: DataFrame, langs: dict[str, list[int]], keep: list[str], size: int = PROFILE) -> DataFrame:
    """lang_pred and score of every row's whole text; narrow, Arrow batches."""
    source = docs.select(*keep, docs["text"].alias("_text"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier(langs, size)
        for whole in batches:
            for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                found = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32 of the id, mod 3, is not 1 (a null id never trains, is not held out)."""
    docs = read_table(spark, sf_dir, "documents")
    langs = profiles(docs.where(crc_mod("doc_id", 3) != 1))
    found = identify(docs, langs, ["doc_id"])
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
