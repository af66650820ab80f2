"""Quality rules: exact base counters, then hashed n-gram logistic regression, calibrated.

The model's features are mean counts of hashed words, word pairs and 3- and
4-grams of code points of the whole text; it is fitted by one executor task on
a bounded sample of labelled rows, batch by batch, and its margin is calibrated
(Platt) on every fifth row of the sample, which the weights never see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, exact_runs, gram_hashes, gram_valid, read_table, split_words, text_buffers, word_blocks
from .toxicity import training_sample

#: Labelled rows that the classifier is fitted on, at most (in expectation), and bytes of their features, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64_000_000
#: Passes over the sample, and rows of a batch.
PASSES, BATCH = 12, 32
BITS = 15
SPACES = 4
#: Fixed thresholds: words at least; repeated words per 100 at most; calibrated probability at least.
MIN_WORDS, MAX_REPEAT, KEEP_AT = 10, 20, 0.5
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RUN = 5


def repeat_words(texts: pa.Array) -> np.ndarray:
    """Per row, the words inside RUN-word windows that the row holds twice or more; windows are compared word for word."""
    words, offsets = split_words(texts)
    rows = len(offsets) - 1
    runs = exact_runs(words)[1]
    at = np.flatnonzero(gram_valid(len(words), offsets, RUN))
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    order = np.lexsort((runs[at], owner[at]))
    same = (runs[at][order][1:] == runs[at][order][:-1]) & (owner[at][order][1:] == owner[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, at[twice], 1)
    np.add.at(mark, at[twice] + RUN, -1)
    return np.bincount(owner[np.cumsum(mark[:-1]) > 0], minlength=rows)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    own = [x for x in lines if x.strip(GAPS)]
    return len(own) - len(set(own))


def buckets(words: np.ndarray, offsets: np.ndarray, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every hashed word, word pair and 3- and 4-gram of the code points of a block."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    pair = gram_hashes(words, 2)
    inside = np.flatnonzero(gram_valid(len(words), offsets, 2))
    pair_at = (pair[inside] >> U64(64 - BITS)).astype(np.int64)
    pair_at[words[inside] == words[inside + 1]] = 0  # a word after itself
    found = [(owner, (words >> U64(64 - BITS)).astype(np.int64)), (owner[inside], pair_at + (1 << BITS))]
    letters = np.repeat(np.arange(rows), np.diff(at))
    ends = np.repeat(at[1:], np.diff(at))
    for k, n in ((2, 3), (3, 4)):
        size = max(0, len(points) - n + 1)
        code = np.zeros(size, np.uint32)
        for j in range(n):
            code = (code ^ points[j : j + size]) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
        ok = np.flatnonzero(np.arange(size) + n <= ends[:size])
        hashed = code[ok] * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        found.append((letters[ok], hashed.astype(np.int64) + k * (1 << BITS)))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def feature_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, words, word offsets, row of each feature, feature) over blocks of whole rows."""
    data, at = text_buffers(column)
    for first, last, words, offsets in word_blocks(column):
        lo, hi = int(at[first]), int(at[last])
        block, cuts = data[lo:hi], at[first : last + 1] - lo
        if len(block) and block.max() < 128:
            points = block.astype(np.uint32)
        else:
            points = np.frombuffer(block.tobytes().decode().encode("utf-32-le"), np.uint32)
            cuts = np.r_[0, np.cumsum((block & 0xC0) != 0x80)][cuts]
        rows, found = buckets(words, offsets, points, cuts)
        yield first, last, words, offsets, rows, found


@dataclass
class Model:
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    fitted: bool = False

    def probability(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """Calibrated probability of good quality; an unfitted model says 1."""
        if not self.fitted:
            return np.ones(n)
        space = rows * SPACES + (found >> BITS)
        total = np.bincount(space, self.weights[found], n * SPACES).reshape(n, SPACES)
        count = np.bincount(space, minlength=n * SPACES).reshape(n, SPACES)
        z = (total / np.maximum(count, 1)).sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, y, and the features of each text with their shares of its kind."""
    for batch in batches:
        ids, ys, keys, values = [], [], [], []
        for first, last, _, _, rows, found in feature_blocks(batch.column(2)):
            cell, count = np.unique(rows * (SPACES << BITS) + found, return_counts=True)
            row, key = cell // (SPACES << BITS), cell % (SPACES << BITS)
            total = np.bincount(row * SPACES + (key >> BITS), count, (last - first) * SPACES)
            value = (count / total[row * SPACES + (key >> BITS)]).astype(np.float32)
            cut = np.searchsorted(row, np.arange(last - first + 1))
            for k in range(last - first):
                keys.append(key[cut[k] : cut[k + 1]].astype("<u4").tobytes())
                values.append(value[cut[k] : cut[k + 1]].tobytes())
            ids += batch.column(0).slice(first, last - first).to_pylist()
            ys += batch.column(1).slice(first, last - first).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "y", "keys", "vals"])


def _train(flat: list[np.ndarray], vals: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression by Adagrad over batches of rows, in an order that the rows' places fix."""
    w, b = np.zeros(SPACES << BITS), 0.0
    seen, seen_b = np.full(SPACES << BITS, 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for turn in range(PASSES):
        order = np.random.default_rng(turn).permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH].tolist()
            keys, value = np.concatenate([flat[i] for i in rows]), np.concatenate([vals[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(flat[i]) for i in rows])
            z = np.bincount(owner, w[keys] * value, len(rows)) + b
            gap = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) / len(rows)
            own, at = np.unique(keys, return_inverse=True)
            g = np.bincount(at, gap[owner] * value)
            seen[own] += g * g
            w[own] -= g / np.sqrt(seen[own])
            seen_b += gap.sum() ** 2
            b -= 0.2 * gap.sum() / np.sqrt(seen_b)
    return w, float(b)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift for margins of rows that trained nothing."""
    slope, shift = 1.0, 0.0
    if not len(z):
        return slope, shift
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        h = np.maximum(p * (1 - p), 1e-4)
        gs, gb = ((p - target) * z).mean(), (p - target).mean()
        slope = max(slope - 0.5 * gs / ((h * z * z).mean() + 1e-3), 1e-2)
        shift -= 0.5 * gb / (h.mean() + 1e-3)
    return float(slope), float(shift)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, modulus: int = 1 << 30) -> Model:
    """Fits on the sample only; without rows of both labels every text counts as good.

    One task holds the sample's features, SAMPLE_BYTES at most (the rows beyond
    that, in order of a hash of their ids, do not train); the driver gets the
    weights alone, one row of a fixed size.
    """
    sample = training_sample(docs, labels, "quality", modulus, sample_rows).select("doc_id", "y", "text")
    made = sample.mapInArrow(_features, "doc_id long, y int, keys binary, vals binary")
    ordered = made.withColumn("place", F.xxhash64("doc_id")).repartition(1).sortWithinPartitions("place", "doc_id", "y")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, vals, ys, held = [], [], [], 0
        for batch in batches:
            for y, keys, values in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                held += len(keys) + len(values)
                if held > SAMPLE_BYTES:
                    continue
                flat.append(np.frombuffer(keys, "<u4"))
                vals.append(np.frombuffer(values, np.float32))
                ys.append(y)
        y = np.array(ys, float)
        if len(y) and y.min() != y.max():
            aside = np.arange(len(y)) % 5 == 4
            inner = np.flatnonzero(~aside).tolist()
            w, b = _train([flat[i] for i in inner], [vals[i] for i in inner], y[inner])
            z = np.array([float(vals[i] @ w[flat[i]]) for i in np.flatnonzero(aside)]) + b
            slope, shift = _calibrated(z, y[aside])
            yield pa.RecordBatch.from_pydict({"weights": pa.array([w.astype("<f4").tobytes()], pa.binary()), "bias": [b], "slope": [slope], "shift": [shift]})

    found = ordered.mapInArrow(train, "weights binary, bias double, slope double, shift double").collect()
    if not found:
        return Model(np.zeros(SPACES << BITS))
    (row,) = found
    return Model(np.frombuffer(row["weights"], "<f4").astype(float), row["bias"], row["slope"], row["shift"], True)


COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("p_quality", pa.float64())]


def judge(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Base counters, verdicts and the probability of every row; narrow.

    Null texts have no words and fail. A probability of just KEEP_AT is kept;
    repeated rows are judged alike; texts of any length are counted whole.
    ``keep`` must not name an added column.
    """
    if {n for n, _ in COLUMNS} & set(keep):
        raise ValueError("keep names a column that is added")
    source = docs.select(*keep, docs["text"].alias("_text"))
    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField(n, kinds[k]) for n, k in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.column(whole.num_columns - 1)
            for first, last, words, offsets, rows, found in feature_blocks(column):
                texts = [t or "" for t in column.slice(first, last - first).to_pylist()]
                n_words = np.diff(offsets)
                repeated = repeat_words(column.slice(first, last - first))
                failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT * n_words)
                p = model.probability(rows, found, last - first)
                values = [
                    n_words,
                    [len(t) - sum(map(t.count, GAPS)) for t in texts],
                    [sum(map(t.count, SYMBOLS)) for t in texts],
                    [duplicate_lines(t) for t in texts],
                    repeated,
                    failed,
                    ~failed & (p >= KEEP_AT),
                    p,
                ]
                part = whole.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + [pa.array(v, k) for v, (_, k) in zip(values, COLUMNS, strict=True)], names=schema.names)

    return source.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
