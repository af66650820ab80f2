"""Parts without Spark: codecs, parsing, models."""

import base64
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vidlake.llm import bpe, chat, common, decontam, html_text, langid, neardup, quality, toxicity, wordpack  # noqa: F401

from . import brute

RANKS = bpe.read_ranks()


@pytest.fixture(scope="module")
def plain():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    import public_tokenizers

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


ODD = st.text(alphabet=list("²½_\u0301\x1c\u00a0" "ab 's'rellvd\n\t\r .,!1é  中\U0001f600~<>"), max_size=120)


@settings(max_examples=300, deadline=None)
@given(ODD, st.integers(1, 9))
def test_tree_encoding_equals_plain(text, leaf):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    codec = bpe.TreeCodec(RANKS, leaf=leaf)
    assert codec.encode(text).tolist() == codec.coder.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()
    assert len(table) > 50_000


def test_long_texts_without_seams(plain):
    codec = bpe.TreeCodec(RANKS, leaf=7)
    for text in ("x" * 900, " " * 700, "\n" * 333 + "a", "ab" * 200 + " " + "c" * 301, "é" * 257):
        assert codec.encode(text).tolist() == plain.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, where, escapes = wordpack.pack(ids)
    assert np.array_equal(wordpack.unpack(words, len(ids), where, escapes), ids)


def test_selectors_fill_at_most_sixty_bits():
    assert all(n * b <= 60 for n, b in wordpack.SELECTORS)
    assert len(wordpack.pack(np.zeros(240, np.uint64))[0]) == 1


def test_shard_round_trip_with_large_and_empty_documents():
    rng = np.random.default_rng(1)
    docs = [(3, rng.integers(0, 50_000, 100_000).astype(np.uint32)), (None, np.zeros(0, np.uint32)), (-7, np.array([2], np.uint32)), (9, rng.integers(0, 9, 40_000).astype(np.uint32))]
    out = io.BytesIO()
    writer = wordpack.ShardWriter(out)
    for doc in docs:
        writer.add(*doc)
    assert writer.close() == 140_001
    back = list(wordpack.read_shard(out))
    assert [d for d, _ in back] == [d for d, _ in docs]
    assert all(np.array_equal(a, b) for (_, a), (_, b) in zip(back, docs, strict=True))


def test_damaged_shard_is_noticed():
    out = io.BytesIO()
    writer = wordpack.ShardWriter(out)
    writer.add(1, np.arange(100, dtype=np.uint32))
    writer.close()
    data = bytearray(out.getvalue())
    data[30] ^= 1
    with pytest.raises(ValueError):
        list(wordpack.read_shard(io.BytesIO(bytes(data))))


SURE = st.text(alphabet=list("ab 's'relld\n\t\r\x0b\x1c .,!$1_-é中²«»“’—。，、\u0301\u3000\u2028ß٣"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ODD, SURE, SURE), min_size=1, max_size=6))
def test_cached_encoder_equals_library(texts):
    import public_tokenizers

    from tokenizers import Tokenizer

    coder = wordpack.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*texts, "a<|endoftext|>b", "“x”—y，z。 w"]
    got = coder.encode(texts)
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b é", max_size=60), min_size=1, max_size=6))
def test_word_hashes_follow_words(texts):
    (first, last, hashes, offsets), *rest = common.word_blocks(pa.array(texts))
    assert (first, last, rest) == (0, len(texts), [])
    words = [w for t in texts for w in brute.WORD.findall(t)]
    assert len(words) == len(hashes)
    assert {(a == b) == (x == y) for a, x in zip(words, hashes, strict=True) for b, y in zip(words, hashes, strict=True)} <= {True}


def test_word_hashes_of_a_text_beyond_the_block(monkeypatch):
    text = "alpha beta  gamma " * 400 + "x" * 900 + " end"
    whole = next(common.word_blocks(pa.array([text])))[2]
    monkeypatch.setattr(common, "BLOCK_BYTES", 64)
    assert np.array_equal(next(common.word_blocks(pa.array([text])))[2], whole)


def test_sliding_extremes():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 7, 26):
        assert np.array_equal(common.slide(x, width, np.minimum), [x[k : k + width].min() for k in range(50 - width + 1)])


@pytest.mark.parametrize("seed", range(5))
def test_quality_counters(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "é"]) for _ in range(rng.randrange(0, 200))) for _ in range(30)] + ["", " \n \n", "a " * 50]
    for first, last, words, offsets, _, _ in quality.feature_blocks(pa.array(texts)):
        repeated = quality.repeat_words(pa.array(texts[first:last]))
        for k in range(first, last):
            n, chars, symbols, dup, rep, _ = brute.base_quality(texts[k])
            assert (int(np.diff(offsets)[k - first]), quality.duplicate_lines(texts[k]), int(repeated[k - first])) == (n, dup, rep)


def test_prefixes_are_shortened_by_what_is_found():
    assert neardup.shortened({}, 8) == neardup.shortened({0.8: 50}, 8) == 6
    assert neardup.shortened({0.99: 100}, 8) == 8
    assert neardup.shortened({0.8: 10**6}, 8, target=0.9999999) < 6


def test_recall_of_planted_pairs_just_above_the_threshold():
    rng = np.random.default_rng(4)
    n, size = 5000, 90
    left = rng.integers(0, 2**63, (n, size)).astype(np.uint64)
    right = left.copy()
    for k in range(n):
        own = rng.integers(8, 11)
        right[k, :own] = rng.integers(0, 2**63, own).astype(np.uint64)
    common_ = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(left, right, strict=True)])
    assert 0.8 <= common_.min() and common_.max() <= 0.85
    offsets = np.arange(n + 1) * size
    a, b = (neardup.min_hashes(x.reshape(-1), offsets)[1] for x in (left, right))
    prefix = neardup.shortened({0.8: n}, neardup.DEPTH)
    found = (a[:, :, :prefix] == b[:, :, :prefix]).all(axis=2).any(axis=1)
    assert found.mean() >= 0.999


@pytest.mark.parametrize("seed", range(4))
def test_linked_pairs_are_exact(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0, 0.05, 0.1, 0.5]), rng.integers(0, 2**62, 60), base)) for _ in range(25)] + [np.zeros(0, np.int64)]
    want = [[5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) > 0 for y in sets] for x in sets]
    every = np.arange(len(sets))
    assert np.array_equal(neardup.linked(sets, every, every), want)
    assert np.array_equal(neardup.linked(sets, every[:12], every[12:]), np.array(want)[:12, 12:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc \n", max_size=40), min_size=1, max_size=6))
def test_exact_shingles(texts):
    sets = neardup.exact_shingles(pa.array(texts))
    plain = []
    for text in texts:
        w = brute.WORD.findall(text)
        plain.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for x, a in zip(sets, plain, strict=True):
        for y, b in zip(sets, plain, strict=True):
            assert (len(x), len(np.intersect1d(x, y))) == (len(a), len(a & b))


def thue_morse(bits):
    s = [0]
    while len(s) < bits:
        s += [1 - x for x in s]
    return s[:bits]


#: Words of equal value under any sum of powers of an odd base, modulo 2**64.
TWINS = [("".join("ab"[b] for b in thue_morse(n)), "".join("ba"[b] for b in thue_morse(n))) for n in (1024, 2048)]


@pytest.mark.parametrize("pair", TWINS)
def test_twin_words_stay_apart(pair):
    import public_tokenizers
    from tokenizers import Tokenizer

    one, two = pair
    hashes = next(common.word_blocks(pa.array([f"{one} {two} {one}"])))[2]
    assert hashes[0] == hashes[2] != hashes[1]
    runs = common.gram_hashes(hashes[np.array(thue_morse(2048) + [1 - x for x in thue_morse(2048)])], 35)
    assert len(np.unique(runs)) > 35
    text = " ".join([one] * 5 + ["mid"] + [two] * 5)
    assert quality.repeat_words(pa.array([text])).tolist() == [brute.base_quality(text)[4]] == [0]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["xxxxxxxx" + one, "xxxxxxxx" + two]
    coder = wordpack.CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [g.tolist() for t in texts for g in coder.encode([t])] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_spans_point_into_the_original():
    text = "Café ONE-two  x"
    raw = text.encode()
    assert [raw[a:b] for a, b in decontam.word_spans(text)] == ["Café".encode(), b"ONE", b"two", b"x"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">buy <p>now</p></div>
<div class="notice">cookies</div><article><h1>Head &amp; more</h1><p><b>First   one.<br><p>Second<span> part</span> &lt;x&gt;&nbsp;end.</p>
<script>var t="</p>";</script><form><p>send</p></form><aside>side</aside>
<section class="comments"><p>reader says</p></section></article><footer>&copy; f</footer>"""


def test_html_main_text():
    found = html_text.blocks(PAGE)
    path, score = html_text.best_container(found)
    assert path == "body/article" and score > 0
    assert html_text.extract(PAGE, path) == "Head & more\nFirst one.\nSecond part <x> end."
    assert html_text.extract(PAGE, "div.other") == html_text.extract(PAGE, None) == html_text.extract(PAGE, path)


@pytest.mark.parametrize("page", [None, "", "plain", "<p", "</p></div>", "<article>", "<!-- open", "<script>x", "<p>a<p>b", "<div class=\"ad\">x</div>", "a<b", "&#0;&bogus;"])
def test_html_odd_pages(page):
    assert isinstance(html_text.extract(page, None), str)
    assert html_text.extract("<p>a<p>b", None) == "a\nb"


def plain_grams(text):
    """N-gram counts by words, as strings."""
    out = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split(" "):
        framed = f"_{word}_"
        for n in (1, 2, 3):
            for k in range(len(framed) - n + 1 if word else 0):
                if framed[k : k + n] != "_":
                    out[framed[k : k + n]] = out.get(framed[k : k + n], 0) + 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_gram_counts_equal_plain(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK_CHARS", block)
    for text in ("", "a", " a ", "The cat's 2 HATS_on été 中文 x²y", "ab  cd\nab", "zz top " * 9, "İstanbul ǅ"):
        codes, counts = langid.gram_counts(text)
        assert {langid.gram_text(c): n for c, n in zip(codes.tolist(), counts.tolist(), strict=True)} == plain_grams(text)
        best = [langid.gram_text(c) for c in langid.ranked(codes, counts, 10).tolist()]
        assert best == [g for g, _ in sorted(plain_grams(text).items(), key=lambda x: (-x[1], x[0]))[:10]]


def profile_of(text):
    return langid.ranked(*langid.gram_counts(text)).tolist()


def test_out_of_place_by_hand():
    assert langid.out_of_place([1, 2, 3], {2: 0, 1: 1}, 10) == 1 + 1 + 10
    model = langid.Identifier({"x": profile_of("aba aba abc"), "y": profile_of("zzz yyy zyz")})
    assert model.predict("aba")[0] == "x" and model.predict("zyz")[0] == "y"
    assert model.predict(None) == model.predict("12 34!") == ("und", 0.0)
    assert langid.Identifier({}).predict("abc") == ("und", 0.0)


def test_identifier_matches_plain_ranking():
    langs = {"x": profile_of("the cat sat on the mat " * 3), "y": profile_of("le chat est la " * 3)}
    model = langid.Identifier(langs)
    for text in ("the rat sat", "la table est le chat", "q" * 50, "a b c d e f g " * 30):
        doc = profile_of(text)
        far = {n: langid.out_of_place(doc, {g: r for r, g in enumerate(p)}, langid.PROFILE) for n, p in langs.items()}
        name = min(far, key=lambda n: (far[n], n))
        assert model.predict(text) == (name, 1 - far[name] / (langid.PROFILE * len(doc)))


def test_label_model_weighs_voters_and_finds_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(float)
    votes = np.stack([((rng.random(4000) < (0.7 if k < 4 else 0.3)) & (y == 1)) | (rng.random(4000) < 0.02) for k in range(6)] * 1, 1).astype(np.int8)
    votes = np.concatenate([votes, votes[:, :1]], 1)
    q, report = toxicity.fit_label_model(votes, y)
    assert ((q >= 0.5) == y).mean() > 0.95
    assert {0, 6} in [{a, b} for a, b, _ in report["correlated"]]


def test_control_words_are_fixed():
    assert re.findall(chat.OPEN + "|" + chat.CLOSE, "<s></s>") == ["<s>", "</s>"]
