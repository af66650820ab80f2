"""The Merkle manifest against a plain tree, over few and many partitions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vidlake.llm import manifest, ranged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def folded(nodes):
    """Levels of the tree over ``nodes``."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, j, own):
    """Siblings from leaf j to the top, and the top that follows from ``own``."""
    beside = []
    for level in levels[:-1]:
        run = level[3 * (j // 3) : 3 * (j // 3) + 3]
        beside += [x for i, x in enumerate(run) if i != j % 3]
        run[j % 3] = own
        own, j = h(*run), j // 3
    return beside, own


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: folded([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = folded([trees[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for j, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            turned = leaf(r[0], r[1] and r[1].replace("\n", ""), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else own
            below, sub = climb(trees[s], j, turned)
            above, root = climb(top, rank, sub)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(*below, *above), root, root == top[-1][0]))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "a\nb", "é\n\nü", "plain", "x" * 20_000])
    hot = [(k, text(), "en", "hot", k) for k in range(400)]
    few = [(1000 + k, text(), rng.choice([None, "de"]), rng.choice([None, "", "a", "b", "é", "zz"]), None) for k in range(120)]
    many = [(2000 + k, "t\n", "fr", f"own{k}", 1) for k in range(70)]
    return {"hot": hot, "mixed": hot + few + many, "one": hot[:1], "pair": few[:2], "nulls": [(None,) * 5] * 40 + [(7, "a\n", None, None, 2)], "repeats": [(4, "r\n", "en", "s", 2)] * 50 + hot[:30]}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("least", [7, 100_000])
def test_equals_a_plain_tree(spark, stored, monkeypatch, name, least):
    monkeypatch.setattr(ranged, "LEAST_ROWS", least)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        rows = cases()[name]
        docs = stored(rows, DOCS)
        got = manifest.manifest(docs, manifest.without_line_feeds(F.col("text"))).collect()
        assert sorted(map(tuple, got), key=repr) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_untampered_rows_verify_and_clashing_columns_are_left_out(stored):
    rows = [(k, "t", "en", "s", 1) for k in range(30)]
    docs = stored([(*r, "7", "7", "7") for r in rows], DOCS + ", leaf string, row string, tampered string")
    got = manifest.manifest(docs).collect()
    assert len(got) == 30 and all(r.verified and r.folded_root == r.root for r in got)
    assert len({r.root for r in got}) == 1


def test_empty_table(stored):
    assert manifest.manifest(stored([], DOCS)).count() == 0
