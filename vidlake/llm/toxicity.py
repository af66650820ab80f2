"""Toxicity by weak supervision.

1. From a bounded, hash-chosen sample of labelled training rows, words and word
   beginnings that separate the classes are mined (document frequencies summed
   in Spark). 2. The most precise become voters: lexicon voters fire on a word,
   pattern voters on a word's beginning or end or on a pattern of the text
   (PATTERNS). 3. A generative model of the votes, a tree-augmented naive Bayes
   fitted by EM, estimates each voter's accuracy, that of the training label as
   one voter more, and each voter's strongest correlation with another one.
   4. Its posteriors over the
   sample train a logistic regression on the mined features, which scores every
   whole text in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, read_table

#: Labelled rows that the classifier is fitted on, at most (in expectation).
SAMPLE_ROWS = 20_000
FEATURES = 800
VOTERS = 48
#: Bounds of a training label's estimated reliability: how often it says 1 where the truth is 1, and where it is 0.
LABEL_HIT, LABEL_FALSE = (0.6, 0.999), (0.001, 0.4)
#: Voters that should speak for each toxic row of the sample, where there are as many.
COVER = 3
#: A voter's word or beginning is toxic at least this often, and is seen in this many toxic rows at least.
PRECISION, SUPPORT = 0.8, 3
#: Lengths of the word beginnings and ends that may vote.
PREFIXES = SUFFIXES = (4, 5, 6)
MODULUS = 5
_WORD = re.compile(r"\w+")
#: Patterns of the whole text that may vote, each under its own name.
PATTERNS = {
    "~masked": re.compile(r"\w[*#@$%]{2,}"),
    "~stretched": re.compile(r"([^\W\d_])\1\1"),
    "~bangs": re.compile(r"[!?]{3}"),
    "~shouted": re.compile(r"(?:\b[A-Z]{3,}\b\W+){3}"),
    "~at you": re.compile(r"\byou\s+\w+[!]", re.I),
}


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text, ``^`` + the beginnings and ``$`` + the ends of longer ones, and names of PATTERNS."""
    words = set(_WORD.findall((text or "").lower()))
    out = words | {"^" + w[:n] for n in PREFIXES for w in words if len(w) > n} | {"$" + w[-n:] for n in SUFFIXES for w in words if len(w) > n}
    return out | {name for name, pattern in PATTERNS.items() if pattern.search(text or "")}


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, size: int) -> DataFrame:
    """doc_id, text, y of about ``size`` labelled rows at most, none of them held out.

    Rows are chosen by a hash of their id; the chosen ids (bounded by ``size``)
    are broadcast. A repeated id counts once: with its greatest label, and one of its texts.
    """
    own = labels.where((crc_mod("doc_id", modulus) != 0) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    total = own.count()
    if total > size:
        own = own.where(unit < size / total)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").dropDuplicates(["doc_id"])


def mine(sample: DataFrame, size: int = FEATURES) -> list[tuple[str, int, int]]:
    """The ``size`` tokens of the highest G statistic with the label: (token, toxic rows, clean rows)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update(tokens(text))
                rows[y] += 1
        held[0][""], held[1][""] = rows
        names = sorted({*held[0], *held[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[1][t] for t in names], pa.int64()), pa.array([held[0][t] for t in names], pa.int64())], names=["token", "bad", "good"])

    sums = sample.select("text", "y").mapInArrow(count, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = sums.where("token = ''").first()
    if totals is None or not totals["bad"] or not totals["good"]:
        return []
    n1, n0 = float(totals["bad"]), float(totals["good"])
    a, b = F.col("bad").cast("double"), F.col("good").cast("double")
    share = (a + b) / (n1 + n0)

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    g = term(a, share * n1) + term(b, share * n0) + term(n1 - a, (1 - share) * n1) + term(n0 - b, (1 - share) * n0)
    top = sums.where((F.col("token") != "") & (a >= SUPPORT) & (a / n1 > b / n0)).orderBy(F.round(g, 6).desc(), "token").limit(size)
    return [(r["token"], r["bad"], r["good"]) for r in top.collect()]


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each row of 0/1 ``votes``, by EM from ``start``.

    ``start`` is the training label itself and stays in the model as one more
    voter, which keeps EM from splitting the rows by language instead of by
    label; its reliability is estimated as the others' are, within bounds.
    First voters are independent given the label; then the maximum spanning
    tree of their conditional mutual information gives each at most one parent,
    and EM goes on with P(vote | label, parent's vote). The report holds each
    voter's accuracy and the correlated pairs.
    """
    n, m = votes.shape
    q = start.astype(float)
    prior = float(np.clip(start.mean(), 1e-3, 1 - 1e-3))
    parent = np.full(m, -1)

    def reliability() -> tuple[float, float]:
        said = start >= 0.5
        hit, false = (q @ said + 0.5) / (q.sum() + 1), ((1 - q) @ said + 0.5) / ((1 - q).sum() + 1)
        return float(np.clip(hit, *LABEL_HIT)), float(np.clip(false, *LABEL_FALSE))

    def posterior() -> np.ndarray:
        hit, false = reliability()
        score = np.where(start >= 0.5, np.log(hit / false), np.log((1 - hit) / (1 - false))) + np.log(prior / (1 - prior))
        for j in range(m):
            v, u = votes[:, j], votes[:, parent[j]] if parent[j] >= 0 else np.zeros(n, np.int8)
            for given in (0, 1):
                rows = u == given
                if rows.any():
                    p1 = (q[rows] @ v[rows] + 0.5 * q.sum() / n + 1e-3) / (q[rows].sum() + q.sum() / n + 2e-3)
                    w = 1 - q
                    p0 = (w[rows] @ v[rows] + 0.01) / (w[rows].sum() + 1.0)
                    score[rows] += np.where(v[rows] == 1, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    for _ in range(rounds):
        q = posterior()
    cmi = np.zeros((m, m))
    for weight in (q, 1 - q):
        total = max(weight.sum(), 1e-9)
        both = (votes.T * weight) @ votes / total
        p = np.diag(both)
        for x in (0, 1):
            for y in (0, 1):
                joint = both if (x, y) == (1, 1) else p[:, None] - both if x else p[None, :] - both if y else 1 - p[:, None] - p[None, :] + both
                alone = (p if x else 1 - p)[:, None] * (p if y else 1 - p)[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cmi += total / n * np.nan_to_num(np.where(joint > 1e-12, joint * np.log(joint / np.maximum(alone, 1e-12)), 0.0))
    inside, pairs = {0} if m else set(), []
    while 0 < len(inside) < m:
        i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda e: cmi[e])
        if cmi[i, j] > 2.0 / max(n, 1):
            parent[j] = i
            pairs.append((i, j, float(cmi[i, j])))
        inside.add(j)
    for _ in range(rounds):
        q = posterior()
    sure = q >= 0.5
    return q, {"accuracy": [(float((votes[:, j] == sure).mean())) for j in range(m)], "correlated": pairs, "label": reliability()}


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    ends: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    report: dict = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        """Probability of label 1; an empty text scores by the bias alone."""
        words = set(_WORD.findall((text or "").lower()))
        total = self.bias + sum(map(self.words.__getitem__, self.words.keys() & words))
        if self.starts:
            total += sum(map(self.starts.__getitem__, self.starts.keys() & {w[:n] for n in PREFIXES for w in words if len(w) > n}))
        if self.ends:
            total += sum(map(self.ends.__getitem__, self.ends.keys() & {w[-n:] for n in SUFFIXES for w in words if len(w) > n}))
        total += sum(v for name, v in self.patterns.items() if PATTERNS[name].search(text or ""))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, total)))))


def choose_voters(rows: list[np.ndarray], y: np.ndarray, able: list[int]) -> list[int]:
    """Greedy multi-cover of the toxic rows by precise tokens that fire on unlike rows.

    Each step takes the token that speaks for most rows still short of COVER
    voters; one that fires nearly where a chosen one does is its copy and is passed over.
    """
    fires: dict[int, set[int]] = {k: set() for k in able}
    for i in np.flatnonzero(y == 1).tolist():
        for k in rows[i].tolist():
            if k in fires:
                fires[k].add(i)
    need = {i: COVER for i in np.flatnonzero(y == 1).tolist()}
    chosen: list[int] = []
    while fires and len(chosen) < VOTERS:
        best = max(fires, key=lambda k: (sum(need[i] > 0 for i in fires[k]), len(fires[k]), -k))
        mine = fires.pop(best)
        if not any(need[i] > 0 for i in mine):
            break
        chosen.append(best)
        for i in mine:
            need[i] -= 1
        fires = {k: f for k, f in fires.items() if len(f & mine) < 0.9 * len(f | mine)}
    return chosen


def train_linear(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 1200, penalty: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features by Adagrad; soft targets."""
    if not rows:
        return np.zeros(size), -8.0
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    seen, seen_b = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, w[flat], len(rows)) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.bincount(flat, gap[owner], size) / len(rows) + penalty * w
        seen += g * g
        seen_b += gap.mean() ** 2
        w -= 1.0 * g / np.sqrt(seen)
        b -= 0.3 * gap.mean() / np.sqrt(seen_b)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The scoring model. Without rows of both labels nothing is toxic."""
    sample = training_sample(docs, labels, "toxic", MODULUS, sample_rows)
    mined = mine(sample)
    if not mined:
        return Model()
    number = {t: k for k, (t, _, _) in enumerate(mined)}

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[t] for t in tokens(x) if t in number) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "found"])

    seen = sorted(sample.select("doc_id", "text", "y").mapInArrow(presence, "doc_id long, y int, found array<int>").collect(), key=lambda r: (r["doc_id"], r["y"], r["found"]))
    rows = [np.array(r["found"], np.int64) for r in seen]
    y = np.array([r["y"] for r in seen], float)
    able = [k for k, (_, bad, good) in enumerate(mined) if (bad + 0.5) / (bad + good + 1) >= PRECISION]
    voters = choose_voters(rows, y, able)
    votes = np.zeros((len(rows), len(voters)), np.int8)
    column = {k: j for j, k in enumerate(voters)}
    for i, found in enumerate(rows):
        votes[i, [column[k] for k in found.tolist() if k in column]] = 1
    q, report = fit_label_model(votes, y)
    report["voters"] = [mined[k][0] for k in voters]
    w, b = train_linear(rows, q, len(mined))
    named = {t: float(w[k]) for t, k in number.items()}
    parts = [{t[1:]: v for t, v in named.items() if t[0] == mark} for mark in "^$"]
    return Model({t: v for t, v in named.items() if t[0] not in "^$~"}, *parts, {t: v for t, v in named.items() if t[0] == "~"}, b, report)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, score and predicted of every row's whole text, however long; narrow.

    ``keep`` must not name an added column. A score of just 0.5 is predicted 1;
    repeated rows score alike; null texts are empty.
    """
    if {"score", "predicted"} & set(keep):
        raise ValueError("keep names a column that is added")
    source = docs.select(*keep, docs["text"].alias("_text"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                found = [model.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=schema.names)

    return source.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", MODULUS) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
