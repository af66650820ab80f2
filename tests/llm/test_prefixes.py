"""The prefix trie against a plain one, over few and many partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from vidlake.llm import prefixes, ranged

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    talks = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        talks[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in talks.items():
        ends[tuple(ts)].append(c)
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], digest(p)) for p, cs in members.items())


def cases():
    rng = random.Random(5)
    say = lambda: rng.choice(["a", "b", "é\n", "", None, "long " * 50])
    deep = [(c, t, rng.choice(["user", "assistant", None]), say()) for c in range(300) for t in range(rng.randrange(1, 9))]
    alike = [(c, t, "user", "same") for c in range(1000, 1150) for t in range(7)]
    first = [(c, t, "user", "hello" if t == 0 else say()) for c in range(1200, 1330) for t in range(4)]
    tall = [(c, t, "user", "t" if t < 150 + c % 3 * 40 else str(c)) for c in range(1400, 1409) for t in range(260)]
    odd = [(1500, None, "user", "x"), (1500, None, "user", "w"), (1500, 0, "user", "y"), (1500, 0, "user", "y"), (None, 0, "user", "z"), (1501, None, None, None), (-7, 0, "user", "n")]
    return {"deep": deep, "alike": alike, "first": first, "tall": tall, "mixed": deep + alike + first + odd, "odd": odd, "one": deep[:1]}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("least", [3, 100_000])
def test_equals_a_plain_trie(spark, stored, monkeypatch, name, least):
    monkeypatch.setattr(ranged, "LEAST_ROWS", least)
    monkeypatch.setattr(prefixes, "PIECE", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = cases()[name]
        rows = [r for r in rows if name != "odd" or r[0] != -7]
        got = prefixes.rebuilt_trie(stored([r for r in rows if r[0] is None or r[0] >= 0], TURNS)).collect()
        assert sorted(map(tuple, got), key=lambda r: (r[:2], r[3:])) == sorted(plain([r for r in rows if r[0] is None or r[0] >= 0]), key=lambda r: (r[:2], r[3:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_points_of_any_cut_agree():
    """Depths of shared points, for every way to cut sorted rows in runs."""
    rng = random.Random(9)
    for _ in range(200):
        keys = sorted(b"".join(bytes([rng.randrange(2)]) * prefixes.SYMBOL for _ in range(rng.randrange(6))) for _ in range(rng.randrange(2, 14)))
        cuts = sorted(rng.sample(range(1, len(keys)), rng.randrange(1, min(6, len(keys)))))
        parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        common = lambda ks: [prefixes.shared_turns(a, b) for a, b in zip(ks, ks[1:], strict=False)]
        rows = [{"part": k, "first": p[0], "last": p[-1], "head": prefixes.falling(common(p)), "tail": prefixes.falling(common(p)[::-1])} for k, p in enumerate(parts)]
        found = prefixes.shared_depths(rows)
        points = {keys[i][: prefixes.SYMBOL * d] for i, d in enumerate(common(keys))} | {b""}
        for k, p in enumerate(parts):
            for side, own, other in ((0, p[0], parts[k - 1][-1] if k else b""), (1, p[-1], parts[k + 1][0] if k + 1 < len(parts) else b"")):
                most = prefixes.shared_turns(own, other)
                assert found[k][side] == [d for d in range(most + 1) if own[: prefixes.SYMBOL * d] in points]


def test_negative_ids_follow_the_sign_of_the_remainder(stored):
    rows = [(-200, 0, "user", "base"), (-207, 0, "user", "own"), (-207, 1, "user", "two")]
    got = prefixes.rebuilt_trie(stored(rows, TURNS)).collect()
    assert {r.conv_id for r in got} <= {-200, -207} and max(r.n_convs for r in got) == 2


def test_empty_table_and_clashing_columns(stored):
    assert prefixes.rebuilt_trie(stored([], TURNS)).count() == 0
    rows = cases()["first"]
    plainly = prefixes.rebuilt_trie(stored(rows, TURNS)).collect()
    clash = prefixes.rebuilt_trie(stored([(*r, "7", "7", "7") for r in rows], TURNS + ", key string, h string, turns string")).collect()
    assert sorted(map(tuple, plainly), key=repr) == sorted(map(tuple, clash), key=repr)
