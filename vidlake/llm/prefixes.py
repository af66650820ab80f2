"""Prefix trie of conversations, built compressed (Patricia) from one global sort.

A turn is the symbol of its role and text: 16 bytes of a SHA-256. A
conversation is the row of its symbols. All rows are sorted once into fixed
partitions by (symbols, conv_id); neighbours' common prefixes then give every
*point*: a prefix where rows branch, end or leave off. Each partition walks its
rows with a stack and holds points only; the turns between two points are one
edge, whose nodes share all counts and are written out at the end from the
edge's running character sums.

Points on the paths across a cut between partitions are *shared*. Their depths
follow from each partition's least common prefixes, which a first pass
gathers; a second pass gathers each partition's share of their counts; the
third, knowing both, writes all nodes. A partition is cut by rows, so a third
of all conversations under one first turn, or all alike, spread as any others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, read_table, staged
from .ranged import sorted_parts

#: Bytes of a turn's symbol.
SYMBOL = 16
#: Ids in a piece of the text whose digest is an end's.
PIECE = 50_000
#: Nodes a batch of the result.
BATCH = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()


def symbol(role: Column, text_print: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text_print), 256), 1, 2 * SYMBOL))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (symbol, chars) in order. Only digests of the texts are shuffled."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("text_print"), F.length(text).alias("chars"))
    each = rows.select("conv_id", F.struct("turn", "role", "text_print", symbol(F.col("role"), F.col("text_print")).alias("symbol"), "chars").alias("t"))
    talks = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return talks.select("conv_id", F.transform("ts", lambda t: F.struct(t.symbol.alias("symbol"), t.chars.alias("chars"))).alias("turns"))


def rebuilt(talks: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its hundred.

    With h = crc32(conv_id) % 6: the first h turns of conversation
    conv_id - conv_id % 100, then the own turns after the first h.
    """
    base = talks.where("conv_id % 100 = 0").select(F.col("conv_id").alias("hundred"), F.slice("turns", 1, 5).alias("lead"))
    own = talks.withColumn("hundred", F.expr("conv_id - conv_id % 100")).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))
    both = own.join(base, "hundred", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(lead, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Common first symbols of two rows of symbols."""
    most = min(len(a), len(b)) // SYMBOL
    if a[: SYMBOL * most] == b[: SYMBOL * most]:
        return most
    return bisect_left(range(most), True, key=lambda k: a[: SYMBOL * (k + 1)] != b[: SYMBOL * (k + 1)])


def _rows(batches: Iterator[pa.RecordBatch]) -> tuple[list[bytes], list[int], list[np.ndarray]]:
    """A partition's symbols, conv_ids and running sums of characters."""
    keys, convs, sums = [], [], []
    for batch in batches:
        keys += batch.column("key").to_pylist()
        convs += batch.column("conv_id").to_pylist()
        chars = batch.column("chars")
        flat = chars.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = chars.offsets.to_numpy() - chars.offsets[0].as_py()
        sums += [np.r_[0, np.cumsum(flat[a:b])] for a, b in zip(at[:-1], at[1:], strict=True)]
    return keys, convs, sums


def falling(values: list[int]) -> list[int]:
    """The values that are lower than all before them."""
    out: list[int] = []
    for v in values:
        if not out or v < out[-1]:
            out.append(v)
    return out


_CUTS = "part int, first binary, last binary, head array<int>, tail array<int>"


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: its first and last row, and the falling minima of its common prefixes from either end."""
    keys, _, _ = _rows(batches)
    if keys:
        common = [shared_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([keys[0]], pa.binary()), "last": pa.array([keys[-1]], pa.binary()), "head": pa.array([falling(common)], pa.list_(pa.int32())), "tail": pa.array([falling(common[::-1])], pa.list_(pa.int32()))}
        )


def shared_depths(cuts: list) -> dict[int, tuple[list[int], list[int]]]:
    """For each partition the depths of shared points on its first and on its last row's path; the root is one.

    A depth is one on the path across a cut if two neighbours on either side
    have just that many turns in common and all rows between have as many.
    """
    cuts = sorted(cuts, key=lambda c: c["part"])
    at = [shared_turns(a["last"], b["first"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    points = [{0, c} for c in at]
    for steps, inner in ((range(len(at)), "tail"), (range(len(at) - 1, -1, -1), "head")):
        held: list[int] = []  # falling minima seen from the cut, lowest first
        for k in steps:
            through = cuts[k if inner == "tail" else k + 1][inner]  # of the partition just passed
            low = through[-1] if through else None
            held = [v for v in held if low is None or v < low] + through[::-1]
            points[k].update(v for v in held if v < at[k])
            held = [v for v in held if v < at[k]] + [at[k]]
    out = {}
    for k, c in enumerate(cuts):
        out[c["part"]] = (sorted(points[k - 1] if k else {0}), sorted(points[k] if k < len(at) else {0}))
    return out


@dataclass
class Point:
    """A prefix of rows[row] of ``depth`` turns, with the counts of what lies under it."""

    row: int
    depth: int
    shared: bool
    up: Point | None = None
    convs: int = 0
    least: int | None = None
    leaves: int = 0
    below: int = 0  # tokens saved under it, its own edge left out
    children: int = 0
    ends: list[int] = field(default_factory=list)  # conv_ids that end here, ascending

    def add(self, conv: int, convs: int = 1) -> None:
        self.convs += convs
        self.least = conv if self.least is None or conv < self.least else self.least


def edge_chars(p: Point, sums: list[np.ndarray]) -> int:
    return int(sums[p.row][p.depth] - sums[p.row][p.up.depth]) if p.up else 0


def local_points(keys: list[bytes], convs: list[int], sums: list[np.ndarray], head: list[int], tail: list[int]) -> list[Point]:
    """A partition's points, each after all under it; counts of shared ones hold this partition's share alone."""
    common = [0, *(shared_turns(a, b) for a, b in zip(keys, keys[1:], strict=False))]
    forced = defaultdict(set)
    forced[0] |= set(head)
    for d in tail:  # from the first of the rows that end this partition and share so many turns
        k = len(keys) - 1
        low = _first_row(common, d)
        forced[min(k, low)].add(d)
    stack: list[Point] = []
    done: list[Point] = []

    def close() -> None:
        p = stack.pop()
        p.up = stack[-1] if stack else None
        done.append(p)
        if p.shared:
            return
        p.leaves = p.leaves or 1
        p.up.add(p.least, p.convs)
        p.up.leaves += p.leaves
        p.up.below += (p.convs - 1) * edge_chars(p, sums) + p.below
        p.up.children += 1

    for i, key in enumerate(keys):
        while stack and stack[-1].depth > common[i]:
            if len(stack) > 1 and stack[-2].depth >= common[i]:
                close()
            else:
                branch = Point(i - 1, common[i], False)
                top = stack.pop()
                stack += [branch, top]
                close()
        own = len(key) // SYMBOL
        for d in sorted(forced.get(i, set()) | {own}):
            if not stack or d > stack[-1].depth:
                stack.append(Point(i, d, d in forced.get(i, ())))
        stack[-1].add(convs[i])
        stack[-1].ends.append(convs[i])
    while stack:
        close()
    return done


def _first_row(common: list[int], depth: int) -> int:
    """The first row of the last run of rows that share ``depth`` turns."""
    k = len(common) - 1
    while k > 0 and common[k] >= depth:
        k -= 1
    return k


def path_id(key: bytes, depth: int) -> bytes:
    return hashlib.blake2b(key[: SYMBOL * depth], digest_size=16).digest() + depth.to_bytes(4, "big")


_SHARES = "id binary, up binary, depth int, edge long, part int, piece int, convs long, least long, leaves long, below long, children long, ends string"
_SHARE_TYPES = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _shares(depths: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This partition's share of each shared point; the ids that end there in pieces."""
        keys, convs, sums = _rows(batches)
        part = TaskContext.get().partitionId()
        if not keys:
            return
        for p in local_points(keys, convs, sums, *depths.value[part]):
            if not p.shared:
                continue
            up = path_id(keys[p.row], p.up.depth) if p.up else None
            own = (p.convs, p.least, p.leaves, p.below, p.children)
            for k in range(max(1, -(-len(p.ends) // PIECE))):
                ids = p.ends[k * PIECE : (k + 1) * PIECE]
                row = (path_id(keys[p.row], p.depth), up, p.depth, edge_chars(p, sums), part, k, *(own if k == 0 else (0, None, 0, 0, 0)), ",".join(map(str, ids)) if ids else None)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SHARE_TYPES, strict=True)], names=[c.split()[0] for c in _SHARES.split(", ")])

    return run


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest) of the comma-joined pieces; rows come by id, partition and piece."""
    last, hashed = None, None
    for batch in batches:
        for own, text in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if own == last:
                hashed.update(b"," + text.encode())
                continue
            if last is not None:
                yield pa.RecordBatch.from_pydict({"id": pa.array([last], pa.binary()), "digest": [hashed.hexdigest()]})
            last, hashed = own, hashlib.sha256(text.encode())
    if last is not None:
        yield pa.RecordBatch.from_pydict({"id": pa.array([last], pa.binary()), "digest": [hashed.hexdigest()]})


@dataclass
class Whole:
    """A shared point's counts over all partitions."""

    convs: int
    least: int
    leaves: int
    below: int
    children: int
    owner: int
    up: bytes | None
    digest: str = NOTHING


def whole_points(rows: list, digests: dict[bytes, str]) -> dict[bytes, Whole]:
    """Shared points with what lies under their shared children added, from merged shares."""
    out: dict[bytes, Whole] = {}
    for r in rows:
        out[bytes(r["id"])] = Whole(r["convs"], r["least"], r["leaves"], r["below"], r["children"], r["part"], bytes(r["up"]) if r["up"] is not None else None, digests.get(bytes(r["id"]), NOTHING))
    edge = {bytes(r["id"]): r["edge"] for r in rows}
    for own in sorted(out, key=lambda i: -int.from_bytes(i[-4:], "big")):
        p = out[own]
        if not p.children:
            p.leaves = 1
        if p.up is not None:
            up = out[p.up]
            up.convs += p.convs
            up.least = min(x for x in (up.least, p.least) if x is not None)
            up.leaves += p.leaves
            up.below += (p.convs - 1) * edge[own] + p.below
            up.children += 1
    return out


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _nodes(depths: dict, wholes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All nodes of this partition's points: the own ones, and shared ones of which it is the first holder."""
        keys, convs, sums = _rows(batches)
        part = TaskContext.get().partitionId()
        if not keys:
            return
        known = wholes.value.get(part, {})
        points = local_points(keys, convs, sums, *depths.value[part])
        for p in points:
            if p.shared:
                w = known[path_id(keys[p.row], p.depth)]
                p.convs, p.least, p.leaves, p.below, p.children = w.convs, w.least, w.leaves, w.below, w.children
        names = [c.split()[0] for c in _NODES.split(", ")]
        out: list[tuple] = []
        for p in points:
            digest = hashlib.sha256(",".join(map(str, p.ends)).encode()).hexdigest() if p.ends else NOTHING
            if p.shared:
                w = known[path_id(keys[p.row], p.depth)]
                if w.owner != part:
                    continue
                digest = w.digest
            if p.up is None:
                out.append((p.least, 0, None, p.convs, p.children, p.leaves, p.below, digest))
                continue
            total, first = sums[p.row], p.up.depth + 1
            for d in range(first, p.depth + 1):
                at_end = d == p.depth
                saved = (p.convs - 1) * int(total[p.depth] - total[d - 1]) + p.below
                out.append((p.least, d, p.up.least if d == first else p.least, p.convs, p.children if at_end else 1, p.leaves, saved, digest if at_end else NOTHING))
                if len(out) == BATCH:
                    yield _batch(out, names)
                    out = []
        if out:
            yield _batch(out, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=names)


def trie(talks: DataFrame) -> DataFrame:
    """One row a node of the trie over ``talks`` (conv_id, turns: array of (symbol, chars)).

    conv_id (the smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Talks without
    turns are members of the root alone. A conv_id that comes twice counts
    twice. An empty table has no node, not even a root.

    A conversation is one row of 20 bytes a turn. The driver holds two rows
    and a few depths a partition, and the points on the paths across cuts.
    """
    spark = talks.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.symbol)), ""))
    kept = staged(talks.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t.chars).alias("chars")), "talks")
    parts = sorted_parts(kept, ["key", "conv_id"])
    drop_staged(kept)
    depths = spark.sparkContext.broadcast(shared_depths(parts.mapInArrow(_cuts, _CUTS).collect()))
    shares = staged(parts.mapInArrow(_shares(depths), _SHARES), "shares")
    sums = [F.sum(c).alias(c) for c in ("convs", "leaves", "below", "children")]
    merged = shares.groupBy("id", "up", "edge").agg(*sums, F.min("least").alias("least"), F.min("part").alias("part"))
    pieces = shares.where("ends is not null").select("id", "part", "piece", "ends").repartition("id").sortWithinPartitions("id", "part", "piece")
    digests = {bytes(r["id"]): r["digest"] for r in pieces.select("id", "ends").mapInArrow(_end_digests, "id binary, digest string").collect()}
    wholes = whole_points(merged.collect(), digests)
    held = defaultdict(dict)
    for r in shares.where("piece = 0").select("id", "part").collect():
        held[r["part"]][bytes(r["id"])] = wholes[bytes(r["id"])]
    drop_staged(shares)
    return parts.mapInArrow(_nodes(depths, spark.sparkContext.broadcast(dict(held))), _NODES)


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Null roles and texts are empty; turns go by (turn, role, digest of the
    text), null turns first, and repeated rows stay. Rows without a conv_id
    are left out: they are no conversation that could be a member. Texts of any
    length enter by their digest and their number of code points; columns
    other than these four are not read, whatever their names.
    """
    return trie(rebuilt(sequences(turns)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(read_table(spark, sf_dir, "conversations"))
