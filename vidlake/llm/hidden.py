"""Hidden Markov language model: counts over the whole corpus, Baum-Welch over partitions, exact scores.

Tokens are lower-cased (A-Z) words and one end a text. The VOCABULARY most
frequent training words are symbols of their own, all other words share the
symbol *rare*, inside which a word has the add-one share of its own count;
that share does not depend on the state, so the forward recursion stays exact
for every word, known or not. A state emits a symbol, then the next state is
drawn; the text is over when the end is emitted, so the probabilities of all
texts add up to one.

Training: word counts (grouped in Spark), symbols of all texts (written once,
two bytes a token), class seeds from neighbour counts of the most frequent
words, then rounds of Baum-Welch, in which every partition runs the scaled
forward and backward recursions over its texts and Spark adds up the expected
counts. Words outside the vocabulary never leave the cluster: their counts are
joined to the texts that hold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_staged, frees_shuffles, read_table, split_words, staged

#: Words with symbols of their own; two-byte symbols hold no more than 65,534.
VOCABULARY = 32_768
#: Words over this many bytes are never in the vocabulary, which bounds what tasks are sent.
LONGEST = 256
STATES = 8
ROUNDS = 3
#: Most frequent words whose neighbour counts seed the states.
SEED_WORDS = 512
#: Prior counts: of a state's symbols (spread as in the corpus) and of its next states.
SYMBOL_PRIOR, STEP_PRIOR = 50.0, 1.0
#: Bytes of text split at a time, tokens that one recursion holds, and tokens of a training piece: bounds of a task's arrays.
TEXT_BYTES, TOKENS, PIECE = 1 << 22, 400_000, 1 << 17


@dataclass
class Vocabulary:
    words: list[str]
    counts: np.ndarray
    ends: int  # training texts
    tokens: int  # training tokens with ends
    types: int  # distinct training tokens, the end among them
    table: DataFrame  # word, c

    @property
    def rare(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1

    @property
    def rare_total(self) -> int:
        """The divisor of a rare word's share: rare tokens, rare words and the unknown one."""
        return self.tokens - self.ends - int(self.counts.sum()) + self.types - (self.ends > 0) - len(self.words) + 1

    def shares(self) -> np.ndarray:
        """The corpus' share of each symbol; rare and end have one more, as either may be new."""
        rare = self.tokens - self.ends - int(self.counts.sum())
        own = np.r_[self.counts, rare + 1, self.ends + 1].astype(float)
        return own / own.sum()


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # by symbol, by state


def pieces_of(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, lower-cased texts) in runs of about TEXT_BYTES; a longer text is a run of its own."""
    column = pc.ascii_lower(column.fill_null("").cast(pa.large_string()))
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + TEXT_BYTES, "right")))
        yield first, column.slice(first, last - first)
        first = last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) by run of texts; the null word counts texts."""
    for batch in batches:
        for _, texts in pieces_of(batch.column("text")):
            words, _ = split_words(texts)
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([batch.num_rows], pa.int64())], names=["word", "c"])


def held_out() -> F.Column:
    return F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))


def most_frequent(table: DataFrame, size: int) -> list:
    """The ``size`` most frequent rows of (word, c), ties by word.

    Counts are first summed up in steps of 2^(1/8): no task sends words whose
    step lies under the one that the last row taken falls in.
    """
    step = F.floor(F.log2("c") * 8)
    wanted, least = size, 0
    for r in sorted(table.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        wanted, least = wanted - r["count"], r["step"]
        if wanted <= 0:
            break
    return table.where(step >= least).orderBy(F.desc("c"), "word").limit(size).collect()


def count(texts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """Counts of all words of the column ``text``; staged."""
    table = staged(texts.select("text").mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0)).alias("ends")).first()
    top = most_frequent(table.where(F.octet_length("word") <= LONGEST), size)
    return Vocabulary([r["word"] for r in top], np.array([r["c"] for r in top], np.int64), total["ends"], total["n"], total["v"], table)


def _code(words: list[str], counts: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.large_string())
        rare = len(words)
        logs = np.r_[np.log10(counts + 1.0), 0.0]
        for batch in batches:
            for first, texts in pieces_of(batch.column("_text")):
                found, at = split_words(texts)
                coded = found.dictionary_encode()
                look = pc.fill_null(pc.index_in(coded.dictionary, known), rare).to_numpy(zero_copy_only=False).astype(np.uint16)
                places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = look[places] if len(look) else np.zeros(0, np.uint16)
                sums = np.r_[0.0, np.cumsum(logs[ids])]
                odd = np.flatnonzero(ids == rare)
                row_of = np.searchsorted(at, odd, "right") - 1
                width = max(1, len(look))
                pairs, n = np.unique(row_of * width + places[odd], return_counts=True)
                cut = pa.array(np.searchsorted(pairs // width, np.arange(len(texts) + 1)), pa.int32())
                raw, n_rare = ids.tobytes(), np.bincount(row_of, minlength=len(texts))
                out = {c: batch.column(c).slice(first, len(texts)) for c in [*keep, "_held"]}
                out["_ids"] = pa.array([raw[2 * a : 2 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                out["_common"] = pa.array(np.diff(at) - n_rare, pa.int64())
                out["_logs"] = pa.array(sums[at[1:]] - sums[at[:-1]], pa.float64())
                out["_rare"] = pa.ListArray.from_arrays(cut, coded.dictionary.take(pa.array(pairs % width)).cast(pa.string()))
                out["_times"] = pa.ListArray.from_arrays(cut, pa.array(n, pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def coded(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """Staged: ``keep``, _held, the symbols of each text, and its rare words with their numbers; _row numbers the rows for good."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, _held boolean, _ids binary, _common long, _logs double, _rare array<string>, _times array<int>"
    rows = docs.select(*keep, held_out().alias("_held"), F.col("text").alias("_text"))
    return staged(rows.mapInArrow(_code(vocabulary.words, vocabulary.counts, keep), schema).withColumn("_row", F.monotonically_increasing_id()), "symbols")


def _sequences(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a batch's texts, each with its end, and their n+1 offsets."""
    raw = [np.frombuffer(b, np.uint16) for b in batch.column("_ids").to_pylist()]
    stop = np.array([end], np.uint16)
    at = np.r_[0, np.cumsum([len(r) + 1 for r in raw])].astype(np.int64)
    return np.concatenate([x for r in raw for x in (r, stop)]) if raw else np.zeros(0, np.uint16), at


def _runs(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences by falling length, in runs of about TOKENS tokens."""
    order = np.argsort(-lengths, kind="stable")
    sums = np.cumsum(lengths[order])
    first = 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + TOKENS, "right")))
        yield order[first:last]
        first = last


def _live(lengths: np.ndarray) -> np.ndarray:
    """How many of the sequences, longest first, have a token at each step."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")


def log_likelihood(model: Model, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural log-likelihood of each sequence, by the scaled forward recursion."""
    lengths, out = np.diff(at), np.zeros(len(at) - 1)
    for run in _runs(lengths):
        starts, logs = at[run], np.zeros(len(run))
        a = None
        for t, n in enumerate(_live(lengths[run])):
            a = (model.start if a is None else a[:n] @ model.step) * model.emit[flat[starts[:n] + t]]
            c = a.sum(1)
            a /= c[:, None]
            logs[:n] += np.log(c)
        out[run] = logs
    return out


class Expected:
    """Expected counts of one task."""

    def __init__(self, symbols: int, states: int):
        self.emit, self.step, self.start, self.log, self.seen = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states), 0.0, np.zeros(symbols, bool)

    def add(self, model: Model, flat: np.ndarray, at: np.ndarray) -> None:
        """Add the sequences' counts. One of over PIECE tokens is taken in pieces, each begun as if any state had come before."""
        cuts = [(a, min(PIECE, b - a), a == lo) for lo, b in zip(at[:-1], at[1:], strict=True) for a in range(lo, b, PIECE)]
        starts, lengths, whole = (np.array(x) for x in zip(*cuts, strict=True)) if cuts else (np.zeros(0, np.int64),) * 3
        start, step, emit = (x.astype(np.float32) for x in (model.start, model.step, model.emit))
        inner = np.full(len(start), 1 / len(start), np.float32) @ step
        for run in _runs(lengths):
            self._add(start, inner, step, emit, flat, starts[run], lengths[run], whole[run].astype(bool))

    def _add(self, start, inner, step, emit, flat, starts, lengths, whole) -> None:
        live = _live(lengths)
        to = np.r_[0, np.cumsum(live)]
        ids = np.empty(to[-1], flat.dtype)
        seen = np.empty((to[-1], len(start)), np.float32)  # emission of each token, step by step
        alpha, scale = np.empty_like(seen), np.empty(to[-1], np.float32)
        a = None
        for t, n in enumerate(live):
            own = slice(to[t], to[t + 1])
            ids[own] = flat[starts[:n] + t]
            seen[own] = emit[ids[own]]
            a = (np.where(whole[:, None], start, inner) if a is None else a[:n] @ step) * seen[own]
            c = a.sum(1)
            a /= c[:, None]
            alpha[own], scale[own] = a, c
        self.log += float(np.log(scale.astype(float)).sum())
        beta, back = np.ones((live[-1], len(start)), np.float32), step.T.copy()
        moved = np.zeros((len(start), len(start)))
        for t in range(len(live) - 1, 0, -1):
            own = slice(to[t], to[t + 1])
            onward = seen[own] * beta / scale[own, None]
            n = live[t]
            moved += alpha[to[t - 1] : to[t - 1] + n].T @ onward
            alpha[own] *= beta
            beta = np.ones((live[t - 1], len(start)), np.float32)
            beta[:n] = onward @ back
        alpha[: to[1]] *= beta
        self.step += moved * step
        self.start += alpha[: to[1]][whole].sum(0, dtype=float)
        self.seen[ids] = True
        for k in range(len(start)):
            self.emit[:, k] += np.bincount(ids, alpha[:, k], len(self.seen))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(item, g0, g1, ...): symbols, then next states by state, first states, log-likelihood."""
        symbols, states = self.emit.shape
        own = np.flatnonzero(self.seen)
        rest = np.vstack([self.step, self.start, np.r_[self.log, np.zeros(states - 1)]])
        items, values = np.r_[own, symbols + np.arange(states + 2)], np.vstack([self.emit[own], rest])
        yield pa.RecordBatch.from_arrays([pa.array(items.astype(np.int32)), *(pa.array(values[:, k].copy()) for k in range(states))], names=["item", *(f"g{k}" for k in range(states))])


def _expect(model, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        found = Expected(*own.emit.shape)
        for batch in batches:
            found.add(own, *_sequences(batch, end))
        yield from found.rows()

    return run


def _neighbours(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pair, n): how often one of the most frequent words follows another."""
        found = np.zeros(size * size, np.int64)
        for batch in batches:
            flat, at = _sequences(batch, 65_535)  # the end is no seed word, so no pair crosses texts
            a, b = flat[:-1].astype(np.int64), flat[1:].astype(np.int64)
            both = (a < size) & (b < size)
            found += np.bincount(a[both] * size + b[both], minlength=size * size)
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(found[own])], names=["pair", "n"])

    return run


def seeded(pairs: np.ndarray, shares: np.ndarray, states: int) -> Model:
    """A first model: words that have like neighbours begin in one state, all others anywhere."""
    size = len(pairs)
    lean = np.full((len(shares), states), 1 / states)
    step = np.full((states, states), 1.0)
    if size > states:
        both = pairs + pairs.T + 1e-9
        scaled = both / np.sqrt(np.outer(both.sum(0), both.sum(0)))
        vectors, values, _ = np.linalg.svd(scaled)
        points = vectors[:, :states] * values[:states]
        points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-12
        centres = points[:1]
        while len(centres) < states:  # the word least like any centre so far is the next
            centres = np.vstack([centres, points[np.argmin((points @ centres.T).max(1))]])
        for _ in range(20):
            nearest = (points @ centres.T).argmax(1)
            centres = np.array([points[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(states)])
        lean[:size] = 0.2 / states + 0.8 * np.eye(states)[nearest]
        hot = np.eye(states)[nearest]
        step += hot.T @ pairs @ hot
    emit = shares[:, None] * lean
    return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def improved(items: np.ndarray, values: np.ndarray, shares: np.ndarray, states: int) -> tuple[Model, float]:
    """The model that the expected counts give, under its priors, and the log-likelihood of the model that gave them."""
    counts = np.zeros((len(shares) + states + 2, states))
    counts[items] = values
    emit = counts[: len(shares)] + SYMBOL_PRIOR * shares[:, None]
    step = counts[len(shares) : len(shares) + states] + STEP_PRIOR
    start = counts[len(shares) + states] + STEP_PRIOR
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0)), float(counts[-1, 0])


def train(texts: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows of ``texts`` (see ``coded``); also the log-likelihood before each round."""
    spark = texts.sparkSession
    shares, ids = vocabulary.shares(), texts.select("_ids")
    size = min(SEED_WORDS, len(vocabulary.words))
    pairs = np.zeros(size * size)
    for r in ids.mapInArrow(_neighbours(size), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect() if size else []:
        pairs[r["pair"]] = r["n"]
    model, logs = seeded(pairs.reshape(size, size), shares, states), []
    names = [f"g{k}" for k in range(states)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        found = ids.mapInArrow(_expect(sent, vocabulary.end), "item int, " + ", ".join(f"{g} double" for g in names))
        rows = found.groupBy("item").agg(*[F.sum(g).alias(g) for g in names]).toPandas()
        model, log = improved(rows["item"].to_numpy(np.int64), rows[names].to_numpy(), shares, states)
        logs.append(log)
    return model, logs


def _likelihood(model, end: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _sequences(batch, end)
            out = {c: batch.column(c) for c in [*keep, "_row", "_held", "_common", "_logs"]}
            out["_all"] = pa.array(np.diff(at), pa.int64())
            out["_model"] = pa.array(log_likelihood(model.value, flat, at) / math.log(10))
            yield pa.RecordBatch.from_pydict(out)

    return run


def score(texts: DataFrame, vocabulary: Vocabulary, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``texts`` (see ``coded``)."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    main = texts.select(*keep, "_row", "_held", "_common", "_logs", "_ids").mapInArrow(_likelihood(sent, vocabulary.end, keep), f"{kinds}, _row long, _held boolean, _common long, _logs double, _all long, _model double")
    pairs = texts.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("p")).select("_row", F.col("p._rare").alias("word"), F.col("p._times").alias("times"))
    joined = pairs.join(vocabulary.table.where("word is not null"), "word", "left")
    per = joined.groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("_rare_logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("_rare_known"), F.sum("times").alias("_n_rare"))
    both = main.join(per, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    end_log, total = math.log10(vocabulary.ends + 1), math.log10(vocabulary.tokens + vocabulary.types + 1)
    return both.select(
        *keep,
        F.col("_held").alias("held_out"),
        F.col("_all").alias("n_tokens"),
        (F.col("_common") + zero("_rare_known") + int(vocabulary.ends > 0)).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("_logs") + zero("_rare_logs") + end_log - F.col("_all") * total).alias("base_score"),
        (F.col("_model") + zero("_rare_logs") - zero("_n_rare") * math.log10(vocabulary.rare_total)).alias("score"),
    )


ADDED = {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}


def language_model(docs: DataFrame, keep: list[str], states: int = STATES, rounds: int = ROUNDS, size: int = VOCABULARY) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) by a model learnt from those whose crc32(doc_id) mod 7 is not 2.

    A null text is empty and has its end alone. A null doc_id is not held out,
    so its text trains. Repeated rows count and are scored each. Among equally
    frequent words the lesser, by code points, enters the vocabulary first. Texts of any
    length are scored whole, in one recursion; in training, one of over PIECE
    tokens is taken in pieces. Without training texts every token is new:
    base_score is 0 and score that of the priors. An empty table gives no rows.
    ``keep`` may not name a column that is added (a ValueError); further
    columns of ``docs`` are left out, whatever their names.
    """
    taken = [c for c in keep if c in ADDED or c.startswith("_")]
    if taken:
        raise ValueError(f"keep names added columns: {taken}")
    with frees_shuffles(docs.sparkSession):
        vocabulary = count(docs.where(~held_out()), size)
        texts = coded(docs, vocabulary, keep)
        model, _ = train(texts.where("not _held"), vocabulary, states, rounds)
        out = staged(score(texts, vocabulary, model, keep), "scores")
    drop_staged(texts, vocabulary.table)
    return out


def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(read_table(spark, sf_dir, "documents"), ["doc_id"])
