"""Merkle manifest of a dataset: one tree a source, one tree of sources, a proof for each row.

H is the lowercase hex SHA-256 of its inputs' concatenated UTF-8 text. A leaf
is H of the row's fields, each ``-`` if null, else byte count, ``:``, value.
While several nodes remain, every three consecutive ones (the last run may be
shorter) become their H.

Leaves are sorted once over all by (source, doc_id, leaf) into fixed
partitions. Counts of the first and the last source of each partition give
every row its place in its source's tree. A partition builds all nodes whose
leaves it holds whole; nodes whose parent it cannot build are *ragged*, at
most two a level and side, and are shuffled by (tree, level, index) to finish
the upper levels. Each partition is then given the few upper nodes that its
rows' proofs need, at most three a level and side, and makes the proofs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_staged, read_table, staged
from .ranged import sorted_parts

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ARITY = 3
#: The tree of sources; trees of sources that span partitions are numbered from 0.
TOP = -1


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _coded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """A row's leaf with ``text`` in place of its text."""
    return F.sha2(F.concat(*[_coded(text if f == "text" else F.col(f)) for f in FIELDS]), 256)


def without_line_feeds(text: Column) -> Column:
    """The tampering of the manifest's own test: line feeds go where 2 divides crc32(doc_id); null where a row is left alone."""
    return F.when(crc_mod("doc_id", 2) == 0, leaf_of(F.replace(text, F.lit("\n"), F.lit(""))))


def size_up(size: int) -> int:
    return -(-size // ARITY)


def build(leaves: list[str], lo: int, size: int) -> list[tuple[int, list[str]]]:
    """By level: first index and hashes of the nodes whose leaves all lie in [lo, lo + len(leaves)) of a tree of ``size`` leaves."""
    out = [(lo, leaves)]
    while size > 1:
        first, have = out[-1]
        end = first + len(have)
        a = size_up(first)
        b = size_up(size) if end == size else end // ARITY
        out.append((a, [digest(have[ARITY * j - first : ARITY * (j + 1) - first]) for j in range(a, b)]))
        size = size_up(size)
    return out


def ragged(levels: list[tuple[int, list[str]]], size: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, hash) of each built node whose parent was not built; the top, if built, is one."""
    for k, (first, have) in enumerate(levels):
        if size == 1:
            yield from ((k, first + i, h) for i, h in enumerate(have))
            return
        above, up = levels[k + 1]
        yield from ((k, first + i, h) for i, h in enumerate(have) if not above <= (first + i) // ARITY < above + len(up))
        size = size_up(size)


def finish(size: int, nodes: dict[tuple[int, int], str]) -> dict[tuple[int, int], str]:
    """All nodes that follow from the ragged ones of a tree of ``size`` leaves, up to its top."""
    found, level = dict(nodes), 0
    by_level = defaultdict(list)
    for k, j in nodes:
        by_level[k].append(j)
    while size > 1:
        for p in sorted({j // ARITY for j in by_level[level]}):
            run = range(ARITY * p, min(ARITY * (p + 1), size))
            if (level + 1, p) not in found and all((level, j) in found for j in run):
                found[level + 1, p] = digest([found[level, j] for j in run])
                by_level[level + 1].append(p)
        size, level = size_up(size), level + 1
    return found


def needed(size: int, starts: list[tuple[int, int]], nodes: dict[tuple[int, int], str]) -> dict[tuple[int, int], str]:
    """The nodes beside and above ``starts``, up to the top of a tree of ``size`` leaves."""
    sizes = [size]
    while sizes[-1] > 1:
        sizes.append(size_up(sizes[-1]))
    out, seen = {}, set()
    for k, j in starts:
        while (k, j) not in seen:
            seen.add((k, j))
            if k == len(sizes) - 1:
                out[k, j] = nodes[k, j]
                break
            for i in range(ARITY * (j // ARITY), min(ARITY * (j // ARITY + 1), sizes[k])):
                if (k, i) in nodes:  # others are inside a partition and known there
                    out[k, i] = nodes[k, i]
            k, j = k + 1, j // ARITY
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> list[tuple[str | None, list, list[str], list[str | None]]]:
    """A partition's rows by source, in order: source, doc_ids, leaves, tampered leaves."""
    out: list = []
    for batch in batches:
        own = [batch.column(n).to_pylist() for n in ("source", "doc_id", "leaf", "tampered")]
        for source, doc_id, leaf, tampered in zip(*own, strict=True):
            if not out or out[-1][0] != source:
                out.append((source, [], [], []))
            out[-1][1].append(doc_id)
            out[-1][2].append(leaf.hex())
            out[-1][3].append(None if tampered is None else tampered.hex())
    return out


_COUNTS = "part int, first string, n_first long, last string, n_last long, sources long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: the first and the last source with their rows here, and how many sources there are."""
    ends: list = []
    sources = 0
    for batch in batches:
        for source, run in groupby(batch.column("source").to_pylist()):
            n = sum(1 for _ in run)
            if ends and ends[-1][0] == source:
                ends[-1][1] += n
                continue
            sources += 1
            ends = [*ends[:1], [source, n]]
    if ends:
        (first, n_first), (last, n_last) = ends[0], ends[-1]
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.string()), "n_first": [n_first], "last": pa.array([last], pa.string()), "n_last": [n_last], "sources": [sources]})


@dataclass
class Place:
    """Where a partition's rows lie: rank of its first source, place of its first row there, and the trees that it shares."""

    rank: int
    at: int
    first: tuple[int, int] | None = None  # number and size of a source's tree that spans partitions
    last: tuple[int, int] | None = None

    def tree(self, k: int, n: int, rows: int) -> tuple[int, int, int]:
        """Number (or -1), size and first place of the k-th of n sources, of which ``rows`` rows are here."""
        shared = self.first if k == 0 else self.last if k == n - 1 else None
        number, size = shared or (TOP, rows)
        return number, size, self.at if k == 0 else 0


def places(counts: list) -> tuple[dict[int, Place], int]:
    """Each partition's Place from the partitions' counts, and the number of sources."""
    out: dict[int, Place] = {}
    ends, sources, last = [], 0, object()
    for c in sorted(counts, key=lambda c: c["part"]):
        out[c["part"]] = Place(sources - (c["first"] == last), 0)
        sources += c["sources"] - (c["first"] == last)
        last = c["last"]
        ends.append((c["first"], c["part"], True, c["n_first"]))
        if c["sources"] > 1:
            ends.append((c["last"], c["part"], False, c["n_last"]))
    alone = {c["part"] for c in counts if c["sources"] == 1}
    trees = 0
    for _, run in groupby(ends, key=lambda e: e[0]):
        held = list(run)
        size, at = sum(e[3] for e in held), 0
        for _, part, is_first, n in held:
            place = out[part]
            if is_first:
                place.at = at
            if len(held) > 1:
                if is_first:
                    place.first = (trees, size)
                if not is_first or part in alone:
                    place.last = (trees, size)
            at += n
        trees += len(held) > 1
    return out, sources


def _trees(segments: list, place: Place, sources: int) -> tuple[list, tuple]:
    """(number, size, rank, levels) of each source here, then of the tree of sources as far as whole sources here build it."""
    out, tops, first = [], [], None
    for k, (_, _, leaves, _) in enumerate(segments):
        number, size, lo = place.tree(k, len(segments), len(leaves))
        levels = build(leaves, lo, size)
        out.append((number, size, place.rank + k, levels))
        if number == TOP:
            first = place.rank + k if first is None else first
            tops.append(levels[-1][1][0])
    return out, (TOP, sources, None, build(tops, first or 0, sources) if tops else [])


_NODES = "tree int, size long, rank long, part int, level int, at long, hash string"


def _ragged_rows(places_of: dict[int, Place], sources: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes of shared trees whose parent cannot be built here; without a hash, a node whose way up is asked for."""
        segments, part = _segments(batches), TaskContext.get().partitionId()
        if not segments:
            return
        own, top = _trees(segments, places_of[part], sources)
        rows = []
        for number, size, rank, levels in [*own, top]:
            if number == TOP and rank is not None:
                continue  # whole here: its top is a leaf of the tree of sources
            rows += [(number, size, rank, part, k, j, h) for k, j, h in ragged(levels, size)]
            if rank is not None:
                rows.append((TOP, sources, None, part, 0, rank, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODE_TYPES, strict=True)], names=_NODE_NAMES)

    return run


_NODE_NAMES = ["tree", "size", "rank", "part", "level", "at", "hash"]
_NODE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]


def _finished(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one tree: for each partition the nodes that its proofs need; for part -1 the top as a leaf of the tree of sources."""
    tree, size = int(rows["tree"].iloc[0]), int(rows["size"].iloc[0])
    built = rows[rows["hash"].notna()]
    nodes = finish(size, dict(zip(zip(built["level"], built["at"], strict=True), built["hash"], strict=True)))
    top = max(nodes)
    out = [(tree, None, int(part), k, j, h) for part, own in rows[rows["part"] >= 0].groupby("part") for (k, j), h in needed(size, list(zip(own["level"], own["at"], strict=True)), nodes).items()]
    if tree != TOP:
        out.append((tree, rows["rank"].iloc[0], -1, *top, nodes[top]))
    return pd.DataFrame(out, columns=["tree", "rank", "part", "level", "at", "hash"])


class Tree:
    """One tree's nodes as far as a partition knows them, with the way up of each node, one memo a level."""

    def __init__(self, levels: list, more: dict[tuple[int, int], str], size: int):
        self.levels, self.more, self.sizes = levels, more, [size]
        while self.sizes[-1] > 1:
            self.sizes.append(size_up(self.sizes[-1]))
        self.memo: dict = {}

    def node(self, k: int, j: int) -> str:
        if k < len(self.levels):
            first, have = self.levels[k]
            if first <= j < first + len(have):
                return have[j - first]
        return self.more[k, j]

    def top(self) -> str:
        return self.node(len(self.sizes) - 1, 0)

    def run(self, k: int, j: int) -> list[str]:
        lo = ARITY * (j // ARITY)
        return [self.node(k, i) for i in range(lo, min(lo + ARITY, self.sizes[k]))]

    def proof(self, k: int, j: int) -> str:
        """The siblings' hashes, left to right, level by level."""
        if k == len(self.sizes) - 1:
            return ""
        beside = self.run(k, j)
        del beside[j % ARITY]
        memo = self.memo.get((k, "proof"))
        if memo is None or memo[0] != j // ARITY:
            memo = self.memo[k, "proof"] = (j // ARITY, self.proof(k + 1, j // ARITY))
        return "".join(beside) + memo[1]

    def fold(self, k: int, j: int, own: str) -> str:
        """The top that follows from ``own`` in a node's place and the original siblings."""
        while k < len(self.sizes) - 1:
            beside = self.run(k, j)
            memo = self.memo.get((k, "fold"))
            if memo is not None and memo[:2] == (j, own):
                return memo[2]
            if beside[j % ARITY] == own:
                found = self.fold(k + 1, j // ARITY, digest(beside))
                self.memo[k, "fold"] = (j, own, found)
                return found
            beside[j % ARITY] = own
            k, j, own = k + 1, j // ARITY, digest(beside)
        return own


#: Rows a batch of the result.
BATCH = 10_000


def _proofs(places_of, needs, sources: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, part = _segments(batches), TaskContext.get().partitionId()
        if not segments:
            return
        own, (_, _, _, top_levels) = _trees(segments, places_of[part], sources)
        more: dict[int, dict] = defaultdict(dict)
        for tree, k, j, h in needs.value.get(part, []):
            more[tree][k, j] = h
        top = Tree(top_levels, more[TOP], sources)
        root = top.top()
        for (_, ids, leaves, tampered), (number, size, rank, levels) in zip(segments, own, strict=True):
            tree = Tree(levels, more[number] if number != TOP else {}, size)
            at, subroot, above = levels[0][0], tree.top(), top.proof(0, rank)
            for lo in range(0, len(ids), BATCH):
                rows = []
                for i in range(lo, min(lo + BATCH, len(ids))):
                    folded = top.fold(0, rank, tree.fold(0, at + i, tampered[i] or leaves[i]))
                    rows.append((leaves[i], subroot, root, digest([tree.proof(0, at + i), above]), folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + BATCH], id_type), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    ``tampered`` is the leaf put to the test in place of a row's own (null:
    the row's own); ``verified`` says whether it and the original siblings give
    the root. Rows of a source go by doc_id, nulls first, then by leaf; rows
    equal in all fields are leaves of their own and share a place's proof only
    by chance. A null source is a source of its own and comes first; a null
    doc_id is carried along; null fields are ``-``. An empty text is ``0:``; a
    text of any length is read once, by the leaf alone. An empty table gives
    no rows and no root. Columns other than the five fields are left out,
    whatever their names.
    """
    spark = docs.sparkSession
    test = F.lit(None).cast("string") if tampered is None else tampered
    leaves = docs.select("source", "doc_id", F.unhex(leaf_of(F.col("text"))).alias("leaf"), F.unhex(test).alias("tampered"))
    # the row number only spreads equal rows; it is written, so it cannot change
    kept = staged(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    parts = sorted_parts(kept, ["source", "doc_id", "leaf", "tampered", "row"]).drop("row")
    places_of, sources = places(parts.mapInArrow(_count, _COUNTS).collect())
    rough = staged(parts.mapInArrow(_ragged_rows(places_of, sources), _NODES), "ragged")
    schema = "tree int, rank long, part int, level int, at long, hash string"
    inner = staged(rough.where(F.col("tree") != TOP).groupBy("tree").applyInPandas(_finished, schema), "upper")
    subroots = inner.where("part = -1").select(F.lit(TOP).alias("tree"), F.lit(sources).cast("long").alias("size"), F.lit(None).cast("long").alias("rank"), "part", F.lit(0).alias("level"), F.col("rank").alias("at"), "hash")
    upper = rough.where(F.col("tree") == TOP).unionByName(subroots).groupBy("tree").applyInPandas(_finished, schema)
    needs = defaultdict(list)
    for r in inner.where("part >= 0").unionByName(upper).collect():
        needs[r["part"]].append((r["tree"], r["level"], r["at"], r["hash"]))
    drop_staged(rough, inner)
    shared = spark.sparkContext.broadcast(dict(needs))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return parts.mapInArrow(_proofs(places_of, shared, sources, _arrow_type(docs)), out)


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"), without_line_feeds(F.col("text")))
