"""The hidden Markov language model: counts and base score against brute force, recursions against plain sums over paths."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vidlake.llm import hidden

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def corpus(n=300):
    rng = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(40)] for c in "abÉ"]
    texts = [" ".join(rng.choice(kinds[d % 3]) for _ in range(rng.randrange(30))) for d in range(n)]
    return texts + [None, "", " \n ", "A0 a0\tÉ1 é1", "new" * 3000, "b1 " * 5000, "only here", "b2 b2"]


def random_model(rng, states, symbols):
    own = lambda *s: (x := rng.random(s) + 0.05) / x.sum(-1, keepdims=True)
    return hidden.Model(own(states), own(states, states), own(states, symbols).T)


def by_paths(model, seq):
    """(probability, expected emissions, steps and starts) by the sum over all paths."""
    states = range(len(model.start))
    total, emit, step, start = 0.0, np.zeros(model.emit.shape), np.zeros(model.step.shape), np.zeros(len(model.start))
    for path in itertools.product(states, repeat=len(seq)):
        p = model.start[path[0]] * math.prod(model.step[a, b] for a, b in zip(path, path[1:], strict=False)) * math.prod(model.emit[s, k] for s, k in zip(seq, path, strict=True))
        total += p
        start[path[0]] += p
        for s, k in zip(seq, path, strict=True):
            emit[s, k] += p
        for a, b in zip(path, path[1:], strict=False):
            step[a, b] += p
    return total, emit / total, step / total, start / total


def test_recursions_equal_sums_over_paths():
    rng = np.random.default_rng(4)
    model = random_model(rng, 3, 5)
    seqs = [rng.integers(0, 5, n) for n in (1, 6, 2, 6, 4, 1, 3)]
    flat, at = np.concatenate(seqs).astype(np.uint16), np.r_[0, np.cumsum([len(s) for s in seqs])]
    plain = [by_paths(model, s) for s in seqs]
    assert np.allclose(hidden.log_likelihood(model, flat, at), [math.log(p[0]) for p in plain])
    found = hidden.Expected(5, 3)
    found.add(model, flat, at)
    for own, k in ((found.emit, 1), (found.step, 2), (found.start, 3)):
        assert np.allclose(own, sum(p[k] for p in plain), atol=1e-4)
    assert found.log == pytest.approx(sum(math.log(p[0]) for p in plain), rel=1e-5)


def test_runs_and_pieces_hold_every_token(monkeypatch):
    rng = np.random.default_rng(6)
    model = random_model(rng, 2, 6)
    seqs = [rng.integers(0, 6, n) for n in (40, 1, 7, 90, 3)]
    flat, at = np.concatenate(seqs).astype(np.uint16), np.r_[0, np.cumsum([len(s) for s in seqs])]
    whole = hidden.log_likelihood(model, flat, at)
    monkeypatch.setattr(hidden, "TOKENS", 10)
    monkeypatch.setattr(hidden, "PIECE", 16)
    assert np.allclose(hidden.log_likelihood(model, flat, at), whole)
    found = hidden.Expected(6, 2)
    found.add(model, flat, at)
    assert np.allclose(found.emit.sum(1), np.bincount(flat, minlength=6), atol=1e-3)
    assert found.start.sum() == pytest.approx(len(seqs), abs=1e-4)


def test_texts_probabilities_add_up_to_one():
    """All texts of up to n tokens, over three symbols and the end."""
    model = random_model(np.random.default_rng(8), 2, 4)
    model.emit[3] = [0.7, 0.6]
    model.emit[:3] *= (1 - model.emit[3]) / model.emit[:3].sum(0)
    total = 0.0
    for n in range(7):
        seqs = [np.array([*s, 3]) for s in itertools.product(range(3), repeat=n)]
        flat, at = np.concatenate(seqs).astype(np.uint16), np.arange(len(seqs) + 1) * (n + 1)
        total += np.exp(hidden.log_likelihood(model, flat, at)).sum()
    assert 0.99 < total <= 1 + 1e-9


def test_columns_equal_brute_force_and_training_helps(spark, documents):
    texts = corpus()
    docs = documents(texts, [None if k == 5 else k for k in range(len(texts))])
    got = {r["id"]: r for r in hidden.language_model(docs.withColumn("id", F.coalesce("doc_id", F.lit(5))), ["id", "doc_id"], states=4, rounds=4, size=50).collect()}
    assert len(got) == len(texts)
    counts = Counter()
    for k, t in enumerate(texts):
        if k == 5 or not is_held(k):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        tokens = [*words(t), None]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k != 5 and is_held(k), len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r.score < 0
    ordinary = [r for r in got.values() if r.held_out and 5 < r.n_tokens < 100]
    assert len(ordinary) > 20 and sum(r.score for r in ordinary) > 1.05 * sum(r.base_score for r in ordinary)


def test_score_is_the_forward_recursion_times_the_rare_shares(spark, documents):
    texts = corpus(60)
    docs = documents(texts)
    vocabulary = hidden.count(docs.where(~hidden.held_out()), 30)
    coded = hidden.coded(docs, vocabulary, ["doc_id"])
    model, logs = hidden.train(coded.where("not _held"), vocabulary, 3, 3)
    assert logs == sorted(logs) and np.allclose(model.emit.sum(0), 1) and np.allclose(model.step.sum(1), 1)
    counts = {r["word"]: r["c"] for r in vocabulary.table.collect()}
    at = {w: k for k, w in enumerate(vocabulary.words)}
    rare = sum(c for w, c in counts.items() if w is not None and w not in at)
    kinds = sum(1 for w in counts if w is not None and w not in at)
    for r in hidden.score(coded, vocabulary, model, ["doc_id"]).collect():
        a, logp = None, 0.0
        for w in [*words(texts[r["doc_id"]]), None]:
            s = vocabulary.end if w is None else at.get(w, vocabulary.rare)
            a = (model.start if a is None else a @ model.step) * model.emit[s]
            logp += math.log10(a.sum()) + (math.log10((counts.get(w, 0) + 1) / (rare + kinds + 1)) if s == vocabulary.rare else 0)
            a = a / a.sum()
        assert r.score == pytest.approx(logp, rel=1e-9)


def test_empty_table_no_training_texts_and_clashing_names(spark, stored, documents):
    assert hidden.language_model(documents([]), ["doc_id"]).count() == 0
    held = [k for k in range(200) if is_held(k)][:5]
    got = hidden.language_model(documents(["a b", None, "c", "", "a"], held), ["doc_id"]).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 5 and all(r.score < 0 for r in got)
    rows = [(k, t, "7", "7", "7") for k, t in enumerate(corpus(20))]
    clash = stored(rows, "doc_id long, text string, word string, _ids string, score string")
    assert hidden.language_model(clash, ["doc_id"], states=2, rounds=1).count() == len(rows)
    with pytest.raises(ValueError, match="keep"):
        hidden.language_model(clash, ["doc_id", "score"])


def test_long_texts_are_split_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(hidden, "TEXT_BYTES", 10)
    texts = pa.array(["aaaa", None, "B" * 50, "c", "d" * 9, ""])
    assert [x for first, run in hidden.pieces_of(texts) for x in run.to_pylist()] == ["aaaa", "", "b" * 50, "c", "d" * 9, ""]


def test_most_frequent_words_with_ties(stored):
    rng = random.Random(1)
    rows = [(f"w{k}", rng.choice([1, 1, 1, 2, 3, 9, 100, 101, 5000])) for k in range(400)]
    table = stored(rows, "word string, c long")
    for size in (1, 7, 60, 399, 1000):
        assert [tuple(r) for r in hidden.most_frequent(table, size)] == sorted(rows, key=lambda r: (-r[1], r[0]))[:size]
    assert hidden.most_frequent(table.limit(0), 5) == []
