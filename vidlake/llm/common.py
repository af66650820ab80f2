"""Shared helpers: input reading, shared-folder staging and vectorised word hashing.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``, taken from the
UTF-8 form of the whole text; a null text counts as empty.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text hashed at a time: bounds the working arrays of one task.
BLOCK_BYTES = 1 << 19


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme; a local session may fall back to /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "vidlake-shared")
    path, store = _path(spark, found.rstrip("/"))
    return store.makeQualified(path).toString()


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


#: Folders written and not yet removed, with their sessions; they go at the end of the driver program at the latest.
_written: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[folder] = spark
    return folder


def remove(folder: str) -> None:
    spark = _written.pop(folder, None)
    if spark is not None:
        path, store = _path(spark, folder)
        store.delete(path, True)


@atexit.register
def _remove_all() -> None:
    for folder in list(_written):
        try:
            remove(folder)
        except Exception:  # the session may have ended first
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.staged_at = folder
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    for df in tables:
        remove(df.staged_at)


@contextmanager
def frees_shuffles(spark: SparkSession):
    """Within, shuffle files of an ended job are removed: its result is staged. The caller's setting comes back after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def print_of(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """id, print, text, copies and first (none, doc_id) of each different text of ``docs`` (doc_id, text); staged.

    Ids are written with the texts and read from there only, so they cannot
    change with the number of executors. Copies are counted before the
    shuffle, which bounds a large group of them by one row a map task.
    """
    rows = docs.select(print_of(F.col("text")).alias("print"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("own"))
    each = rows.groupBy("print").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("own").alias("first"))
    return staged(each.select(F.monotonically_increasing_id().alias("id"), "print", "text", "copies", "first"), "texts")


def crc_mod(col: str, modulus: int):
    return F.crc32(F.col(col).cast("string")) % F.lit(modulus)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a string column and the n+1 word offsets of its rows."""
    column = column.fill_null("").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(column)
    words = lists.flatten()
    at = lists.offsets.to_numpy(zero_copy_only=False)
    at = at - at[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty piece
    return words.filter(pa.array(real)), np.r_[0, np.cumsum(real)][at]


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """xxh3 of each word's bytes; equal words of the block are found exactly and hashed once."""
    coded = words.dictionary_encode()
    unique = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], U64)
    return unique[coded.indices.to_numpy(zero_copy_only=False)] if len(unique) else np.zeros(0, U64)


def word_blocks(column: pa.Array, seed: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, word hashes, n+1 word offsets) over blocks of whole rows.

    A row larger than a block is hashed in pieces cut at white space.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, at = text_buffers(column)
    rows, first = len(at) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
        lo, hi = int(at[first]), int(at[last])
        if hi - lo <= 2 * BLOCK_BYTES:
            words, offsets = split_words(column.slice(first, last - first))
            hashes = word_hashes(words, seed)
        else:
            parts, p = [], lo
            while p < hi:
                q = min(hi, p + BLOCK_BYTES)
                while q < hi:
                    gap = np.flatnonzero(IS_SPACE[data[q : q + BLOCK_BYTES]])
                    q = q + int(gap[0]) if len(gap) else min(hi, q + BLOCK_BYTES)
                    if len(gap):
                        break
                parts.append(word_hashes(split_words(pa.array([data[p:q].tobytes().decode()]))[0], seed))
                p = q
            hashes = np.concatenate(parts)
            offsets = np.array([0, len(hashes)])
        yield first, last, hashes, offsets
        first = last


_ODD = U64(0x9E3779B97F4A7C17)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, order counting; mixed at each level, so no sum of powers can cancel."""
    return mix(a * _ODD + b + U64(1))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by start; runs may cross rows (see ``gram_valid``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, part, width = None, 0, words, 1
    while True:
        if k // width % 2:
            own = part[done : done + n]
            out = own if out is None else paired(out, own)
            done += width
        if done == k:
            return mix(out + U64(k))
        part = paired(part[:-width], part[width:])
        width *= 2


def exact_runs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, and one for each run of five by start: equal for equal words and no others."""
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base = max(2, len(coded.dictionary))
    if len(ids) < 5:
        return ids, np.zeros(0, np.int64)
    if base**5 < 1 << 62:
        n = len(ids) - 4
        runs = np.zeros(n, np.int64)
        for k in range(5):
            runs = runs * base + ids[k : k + n]
        return ids, runs
    two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (len(two) + 1) + two[2:], return_inverse=True)[1]
    return ids, four[:-1] * base + ids[4:]


def gram_valid(n_words: int, offsets: np.ndarray, k: int) -> np.ndarray:
    """Whether the k-word run at each start stays inside one row."""
    n = n_words - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(n) + k <= ends[:n]


def slide(values: np.ndarray, width: int, combine) -> np.ndarray:
    """combine (np.minimum or np.maximum) over every full run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = combine(out[: len(out) - step], out[step:])
        have += step
    return out


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
