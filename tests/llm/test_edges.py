"""Empty tables, clashing extra columns, nulls in every column, repeated rows: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

from vidlake.llm import bpe, chat, decontam, html_text, langid, neardup, quality, substrings, toxicity, wordpack

LABELS = "doc_id long, quality int, toxic int"
CLASH = ["_rid", "_text", "score", "n_words", "n_removed", "nodes", "places", "predicted", "class_id", "print", "y", "lang_pred", "_marks", "ids"]


@pytest.fixture()
def labels(stored):
    return stored([(k, 1, k % 2) for k in range(1, 20)] + [(None, None, None), (3, None, 1)], LABELS)


def document_operators(docs, labels, bench, tmp_path):
    yield "near", neardup.near_duplicates(docs, ["doc_id"])
    yield "substrings", substrings.dedup(docs, ["doc_id"], texts=True)
    yield "decontaminate", decontam.decontaminate(docs, bench, ["doc_id"])
    yield "bpe", bpe.encode_decode(docs, bpe.read_ranks(), ["doc_id"])
    yield "toxicity", toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    yield "quality", quality.judge(docs, quality.fit(docs, labels), ["doc_id"])
    yield "language", langid.identify(docs, langid.profiles(docs), ["doc_id"])
    folder = f"file://{tmp_path}/ids-{docs.count()}"
    yield "ids", wordpack.read_shards(docs.sparkSession, folder, wordpack.write_shards(docs, folder))


def test_empty_tables(spark, documents, stored, labels, tmp_path):
    docs = documents([])
    bench = stored([], "item_id long, text string")
    for name, found in document_operators(docs, labels.limit(0), bench, tmp_path):
        assert found.count() == 0, name
    turns = stored([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.examples(turns)).count() == 0
    assert html_text.extract_pages(stored([], "page_id long, url string, html string"), ["page_id"]).count() == 0


def test_clashing_columns_nulls_and_repeats(spark, documents, stored, labels, tmp_path):
    long = " ".join(f"w{k % 37}x{k}" for k in range(30_000))
    texts = ["a b c d e f g", "a b c d e f g", None, "", "x" * 50_000, long, long + " end", "!", "ñandú été"]
    base = documents(texts, [1, 1, None, 3, 4, 5, 6, None, 8])
    rows = [tuple(r) for r in base.withColumn("lang", F.when(F.col("doc_id") < 5, F.col("lang"))).collect()]
    plain = stored(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = stored([(*r, *["7"] * len(CLASH)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    bench = stored([(1, "c d e"), (None, "x"), (2, None), (2, "c d e")], "item_id long, text string")
    results = []
    for docs in (plain, clash):
        got = {}
        for name, found in document_operators(docs, labels, bench, tmp_path / ("a" if docs is plain else "b")):
            got[name] = sorted(map(repr, found.collect()))
            assert len(got[name]) == len(texts), name
        results.append(got)
    assert results[0] == results[1]


def test_pages_with_clashes(spark, stored):
    pages = stored([(1, "http://h/x", "<article><p>t</p></article>", "7", "7")], "page_id long, url string, html string, _host string, text string")
    assert [tuple(r) for r in html_text.extract_pages(pages, ["page_id", "url"]).collect()] == [(1, "http://h/x", "t", 1)]
