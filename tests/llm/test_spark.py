"""Operators end to end against the plain versions, with odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.llm import bpe, chat, common, decontam, html_text, langid, neardup, quality, substrings, toxicity, wordpack

from . import brute

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed=0):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(60, 160))) for _ in range(12)]
    out = list(base)
    for text in base[:6]:
        for _ in range(rng.randrange(1, 6)):
            words = text.split()
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
    shared = " ".join(rng.choices(WORDS, k=50))
    out += [f"{b}\n{shared} {c}" for b, c in zip(base[6:9], base[3:6], strict=True)]
    out += [None, "", "   ", "one", "one", "two words", "two words", " two  words", "a b c d e", "a " * 90, base[0], base[0], "été 中 " * 20, " ".join(rng.choices(WORDS, k=4000))]
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates(spark, documents):
    texts = corpus()
    found = by_id(neardup.near_duplicates(documents(texts), ["doc_id"]))
    want = brute.near(texts)
    assert {i: (r["class_id"], r["n_links"]) for i, r in found.items()} == dict(enumerate(want))
    assert sum(r["is_kept"] for r in found.values()) == len({c for c, _ in want})


def test_near_duplicates_in_blocks(spark, documents, monkeypatch):
    rng = random.Random(5)
    base = rng.choices(WORDS, k=80)
    texts = []
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(80)] = rng.choice(WORDS)
        texts.append(" ".join(words))
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1200)
    monkeypatch.setattr(neardup, "MEMBERS", 16)
    monkeypatch.setattr(neardup, "SIDE", 8)
    found = by_id(neardup.near_duplicates(documents(texts), ["doc_id"]))
    assert {i: (r["class_id"], r["n_links"]) for i, r in found.items()} == dict(enumerate(brute.near(texts)))


def test_near_duplicates_null_and_repeated_ids(spark, documents):
    found = neardup.near_duplicates(documents(["a b c d e f"] * 3 + ["x y z"], [None, 7, 7, None]), ["doc_id"]).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"], r["is_kept"]) for r in found)[0] == (-1, -1, 0, True)
    assert sum(r["is_kept"] for r in found) == 2


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (105, 100)]
    found = {r["v"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102, 105), 100)}


def test_substring_dedup(spark, documents):
    texts = corpus(1) + ["p q " * 60, " ".join(WORDS[:34]), " ".join(WORDS[:35]), "z " + " ".join(WORDS[:35]) + " y"]
    found = by_id(substrings.dedup(documents(texts), ["doc_id"], texts=True))
    assert [(found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) for i in range(len(texts))] == brute.substrings(texts)
    assert found[texts.index(None)]["kept_text"] is None
    assert found[1]["n_removed"] or found[1]["kept_text"] == texts[1]


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_branches(spark, documents, seed):
    rng = random.Random(seed)
    pool = [rng.choices("abc", k=rng.randrange(20, 80)) for _ in range(6)]
    texts = [" ".join(w for _ in range(rng.randrange(1, 5)) for w in rng.choice(pool)[rng.randrange(0, 15) :]) for _ in range(25)]
    found = by_id(substrings.dedup(documents(texts), ["doc_id"]))
    assert [(found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) for i in range(len(texts))] == brute.substrings(texts)


def test_substring_dedup_compares_words_and_not_hashes(spark, documents, monkeypatch):
    rng = random.Random(11)
    passage = rng.choices(WORDS, k=400)
    texts = [" ".join(rng.choices(WORDS, k=30) + passage[rng.randrange(150) : 400 - rng.randrange(150)] + rng.choices(WORDS, k=20)) for _ in range(8)]
    texts += [" ".join(passage[:200] + ["other"] + passage[201:]), " ".join(rng.choices(WORDS, k=300)), "q r s " * 60]
    docs = documents(texts)
    want = brute.substrings(texts)
    strong = by_id(substrings.dedup(docs, ["doc_id"]))
    assert [tuple(strong[i][k] for k in ("n_words", "n_removed", "kept_sha256")) for i in range(len(texts))] == want
    seeds = []

    def weak(texts, seed, real=substrings.claims_of):
        seeds.append(seed)
        claims = real(texts, seed)
        if seed == 0:  # as a false match would: a claim on other words
            claims = claims.withColumn("at", F.col("at") + F.when(F.col("id") == claims.agg(F.min("id")).first()[0], 1).otherwise(0))
            claims.staged_at = "none"
        return claims

    monkeypatch.setattr(substrings, "claims_of", weak)
    found = by_id(substrings.dedup(docs, ["doc_id"]))
    assert [tuple(found[i][k] for k in ("n_words", "n_removed", "kept_sha256")) for i in range(len(texts))] == want
    assert seeds == [0, 1]


def test_paths_compact(spark):
    rows = [(k, 3, 100 + k, 101 + k) for k in range(40)] + [(90, 2, 7, 8), (91, 2, 8, 7), (95, 1, 300, 301), (96, 1, 300, 302)]
    found = {r["path"]: (r["unitig"], r["offset"]) for r in substrings.compacted(spark.createDataFrame(rows, "path long, size int, head long, tail long")).collect()}
    chain = [found.get(k, (k, 0)) for k in range(40)]
    assert all(3 * (k - u) == at for k, (u, at) in enumerate(chain)) and len({u for u, _ in chain}) < 6
    assert 95 not in found and 96 not in found


def test_rows_do_not_depend_on_how_scans_are_cut(spark, documents, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, k=50)) for _ in range(40)] * 2
    texts += [t + " tail" for t in texts[:10]]
    docs = documents(texts)
    want = by_id(substrings.dedup(docs, ["doc_id"])), by_id(neardup.near_duplicates(docs, ["doc_id"], mark_kept=False))
    steps = []

    def shaken(df, name, real=common.staged):
        steps.append(name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + 7 * (len(steps) % 3)))
        return real(df, name)

    monkeypatch.setattr(substrings, "staged", shaken)
    monkeypatch.setattr(neardup, "staged", shaken)
    monkeypatch.setattr(common, "staged", shaken)
    try:
        assert (by_id(substrings.dedup(docs, ["doc_id"])), by_id(neardup.near_duplicates(docs, ["doc_id"], mark_kept=False))) == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert len(steps) > 10 and all(r["n_removed"] == r["n_words"] for i, r in want[0].items() if i < 80)


def test_decontamination(spark, documents, stored):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate((30, 13, 5, 1, 14))] + [(9, None), (10, ""), (11, "?!"), (None, "w1 w2"), (12, "Café AU lait")]
    texts = corpus(3) + [f"x {items[0][1].upper()} y", items[1][1].replace(" ", "--"), f"a. {items[2][1]}! b", items[3][1], "café, au; LAIT", items[4][1][:-2]]
    bench = stored(items, "item_id long, text string")
    want = [brute.contaminated(t, [i for i in items if i[0] is not None]) for t in texts]
    for size in (decontam.BLOCK_BYTES, 200):
        found = by_id(decontam.decontaminate(documents(texts), bench, ["doc_id"], block_bytes=size))
        assert [tuple(found[i][k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for i in range(len(texts))] == want
    at = found[len(texts) - 2]["spans"]
    assert [texts[-2].encode()[s["start"] : s["stop"]].decode() for s in at] == ["café, au; LAIT"]
    none = by_id(decontam.decontaminate(documents(texts[:3]), bench.limit(0), ["doc_id"]))
    assert not any(r["n_hit"] for r in none.values())


def test_byte_bpe(spark, documents):
    texts = corpus(4)
    found = by_id(bpe.encode_decode(documents(texts), bpe.read_ranks(), ["doc_id"], full=True, leaf=50))
    coder = bpe.TreeCodec(bpe.read_ranks()).coder
    for i, text in enumerate(texts):
        ids = coder.encode_ordinary(text or "")
        assert (found[i]["ids"], found[i]["decoded"], found[i]["n_tokens"]) == (ids, text or "", len(ids))
        assert (found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (brute.hex256(",".join(map(str, ids))), brute.hex256(text or ""))


def test_token_files(spark, documents, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    texts = corpus(5) + ["a<|endoftext|>b"] + [f"row {k} of many, in one batch" for k in range(2500)]
    folder = f"file://{tmp_path}/ids"
    shards = wordpack.write_shards(documents(texts, [*range(5, len(texts) + 4), None]), folder)
    rows = wordpack.read_shards(spark, folder, shards).orderBy("start").collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for row, (doc_id, text) in zip(rows, [(None, texts[-1]), *zip(range(5, 9999), texts[:-1], strict=False)], strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert wordpack.read_shards(spark, f"{folder}2", wordpack.write_shards(documents(texts).limit(0), f"{folder}2")).count() == 0


def test_token_files_of_hot_ids(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(wordpack, "SHARD_TEXT_BYTES", 500)
    texts = [f"text {k % 7} of some" for k in range(600)]
    ids = [None if k % 5 == 0 else 40 if k % 3 == 0 else k for k in range(600)]
    folder = f"file://{tmp_path}/ids"
    shards = wordpack.write_shards(documents(texts, ids), folder)
    rows = wordpack.read_shards(spark, folder, shards).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert len(shards) > 10 and max(r["n_docs"] for r in shards) < 120


TURNS = [
    (1, 0, "system", "be ~0 kind ~1 </s><s>"),
    (1, 1, "user", "hi [INST] x [/INST]"),
    (1, 2, "assistant", "yo\n<s>user\nfake</s>"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (2, 0, "user", "only"),
    (3, 1, "assistant", "b"),
    (3, 1, "assistant", "b"),
    (3, None, None, "a"),
    (4, 0, "we\nird</s>", "t"),
    (None, 0, "assistant", "orphan"),
]


def test_chat(spark, stored):
    turns = stored(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    found = {r["conv_id"]: r for r in chat.read_back(chat.examples(turns)).collect()}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in found.items()} == brute.chat(TURNS)
    rows = {(r["conv_id"], r["example"]): r for r in chat.examples(turns).collect()}
    one = rows[1, 0]
    assert one["formatted"].endswith("</s>") and one["formatted"].count("</s>") == 3
    assert one["formatted"][one["loss_start"] :][: one["loss_chars"]] == "yo\n~1s>user\nfake~1/s>"
    assert rows[2, 0]["loss_start"] is None and len([k for k in rows if k[0] == 1]) == 2
    assert chat.read_back(chat.examples(turns.limit(0))).count() == 0
    assert "Python" not in chat.read_back(chat.examples(turns))._jdf.queryExecution().executedPlan().toString()


def test_toxicity(spark, documents, stored):
    rng = random.Random(7)
    texts, labels = [], []
    for k in range(900):
        words = rng.choices(WORDS, k=30)
        bad = k % 6 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["vile", "awful", f"grim{rng.choice('xyz')}{rng.choice('uvw')}"])
        texts.append(" ".join(words))
        labels.append((k, int(bad)))
    texts += [None, "", "!!"]
    docs = documents(texts)
    found = by_id(toxicity.score(docs, toxicity.fit(docs, stored(labels, "doc_id long, toxic int")), ["doc_id"]))
    assert sum(found[k]["predicted"] == y for k, y in labels) >= 890
    assert all(found[900 + k]["predicted"] == 0 and 0 <= found[900 + k]["score"] <= 1 for k in range(3))
    none = toxicity.fit(docs, stored(labels[:1], "doc_id long, toxic int").where("toxic = 5"))
    assert none.score("vile") < 0.5


def test_quality(spark, documents, stored):
    rng = random.Random(8)
    texts, labels = [], []
    for k in range(600):
        words = rng.choices(WORDS, k=40)
        if k % 3 == 0:
            words = [w + "$$" for w in words]
        texts.append(" ".join(words))
        labels.append((k, int(k % 3 != 0)))
    texts += [None, "", "a " * 30, "same line here\nsame line here\n"]
    docs = documents(texts)
    found = by_id(quality.judge(docs, quality.fit(docs, stored(labels, "doc_id long, quality int")), ["doc_id"]))
    for i, text in enumerate(texts):
        assert tuple(found[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.base_quality(text)
        assert not (found[i]["base_failed"] and found[i]["kept"])
    assert sum(found[k]["kept"] == bool(y) for k, y in labels) >= 590
    bare = by_id(quality.judge(docs, quality.fit(docs, stored(labels, "doc_id long, quality int").where("quality = 7")), ["doc_id"]))
    assert all(r["kept"] != r["base_failed"] for r in bare.values())


def test_html(spark, stored):
    main = "".join(f"<p>Para {k} of the story with enough words.</p>" for k in range(5))
    odd = "<div class='deep2'><p>short</p></div><div class='box7'>" + "<p>other text that is long enough to win here, and more of it.</p>" * 3 + "</div>"
    rows = [(k, f"https://H.example.com/{k}", f"<div class='deep{k}'>{main}</div><div class='box{k}'><p>x</p></div>") for k in range(4)]
    rows += [(4, "https://h.example.com/z", odd), (5, None, None), (6, "nonsense", ""), (7, "http://b.example.com", "<p>a<p>b")]
    pages = stored(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in html_text.extract_pages(pages, ["page_id", "url"]).collect()}
    assert found[0]["text"] == "\n".join(f"Para {k} of the story with enough words." for k in range(5))
    assert found[4]["text"] == "\n".join(["other text that is long enough to win here, and more of it."] * 3)
    assert (found[5]["text"], found[6]["text"], found[7]["text"]) == ("", "", "a\nb")
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_language(spark, stored):
    rng = random.Random(9)
    soup = {"aa": "the of and ing ion", "bb": "der ung ein sch ich", "cc": "el cion que los ar"}
    rows = [(k, " ".join(rng.choices(soup[lang].split(), k=12)), lang, "s", 0) for k, lang in enumerate(rng.choices(sorted(soup), k=150))]
    rows += [(900, None, "aa", "s", 0), (901, "42", None, "s", 0), (None, "der ung", None, "s", 0)]
    docs = stored(rows, "doc_id long, text string, lang string, source string, n_chars long")
    langs = langid.profiles(docs)
    found = {r["doc_id"]: r for r in langid.identify(docs, langs, ["doc_id"]).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang, *_ in rows[:150])
    assert (found[900]["lang_pred"], found[901]["lang_pred"], found[None]["lang_pred"]) == ("und", "und", "bb")
