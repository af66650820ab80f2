"""Exact top-k inner products that skip blocks which cannot hold a better one.

References are dealt to pivots (the nearest of a bounded sample) and packed as
blocks with their centre c and radius r. For a query q no score in a block
exceeds q.c + |q| r. A first round scores each pack of queries against the
few blocks whose centres promise most; the k-th best score so far is then a
floor for each query. In the second round a pack is sent to a block only with
those of its queries whose bound reaches their floor, so what is shipped is
the blocks once and each query as often as it needs to be. No bound, no loss:
where vectors do not cluster most pairs survive, and then the rows come from the
plain search, which ships no query more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .search import best_of, ranked, topk_inner_product

#: Most pivots, vectors a block or pack is meant to hold, block centres of one map, blocks of the first round.
PIVOTS, BLOCK, MAP, FIRST = 4096, 512, 2048, 2
#: Slack for rounding, relative to the size of a bound.
SLACK = 1e-9


def _matrix(flat: pa.Array, rows: int) -> np.ndarray:
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def _held(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _near_pivots(df: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """(pivot, key, vec): each vector with its nearest pivot."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, half = sent.value, (sent.value**2).sum(1) / 2
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                nearest = (_matrix(part.column("vec"), part.num_rows) @ held.T - half).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), part.column(key), part.column("vec")], names=["pivot", key, "vec"])

    return df.select(key, "vec").mapInArrow(run, f"pivot int, {key} long, vec array<double>")


_PACKED = "pack long, ids array<long>, matrix binary, centre array<double>, radius double"


def _packs(df: DataFrame, key: str, pivots: np.ndarray, size: int, name: str) -> DataFrame:
    """Staged packs of about ``size`` vectors of one pivot each; a crowded pivot's vectors are split by a hash."""
    near = _held(_near_pivots(df, key, pivots), "near")
    crowd = near.groupBy("pivot").agg(F.ceil(F.count("*") / size).alias("_n"))  # a row a pivot
    number = F.pmod(F.xxhash64(key), F.col("_n"))
    dealt = near.join(F.broadcast(crowd), "pivot").select((F.col("pivot").cast("long") * (1 << 40) + number).alias("pack"), F.col(key).alias("_key"), "vec")

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows["_key"].to_numpy()
        order = np.argsort(ids, kind="stable")
        held = _matrix(rows["vec"].combine_chunks(), len(ids))[order]
        centre = held.mean(0)
        radius = float(np.linalg.norm(held - centre, axis=1).max())
        return pa.table({"pack": [rows["pack"][0].as_py()], "ids": pa.array([ids[order].tolist()], pa.list_(pa.int64())), "matrix": pa.array([held.tobytes()], pa.binary()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    return _held(dealt.groupBy("pack").applyInArrow(pack, _PACKED), name)


def _maps(blocks: DataFrame) -> DataFrame:
    """Centres and radii of up to about MAP blocks a row."""
    n = max(1, -(-blocks.count() // MAP))
    each = blocks.select(F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int").alias("map"), F.struct("pack", "centre", "radius").alias("b"))
    listed = each.groupBy("map").agg(F.collect_list("b").alias("bs"))
    return _held(listed.select("map", F.col("bs.pack").alias("blocks"), F.flatten("bs.centre").alias("centres"), F.col("bs.radius").alias("radii")), "maps")


def _rows_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers and vectors of a joined row, and its map's blocks and bounds' parts."""
    ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
    asked = np.frombuffer(batch.column("matrix")[i].as_buffer(), np.float64).reshape(len(ids), -1)
    blocks = batch.column("blocks")[i].values.to_numpy(zero_copy_only=False)
    centres = batch.column("centres")[i].values.to_numpy(zero_copy_only=False).reshape(len(blocks), -1)
    return ids, asked, blocks, centres


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, block, promise) of the FIRST blocks of each map whose centres a pack's queries favour."""
    for batch in batches:
        for i in range(batch.num_rows):
            _, asked, blocks, centres = _rows_of(batch, i)
            score = (asked @ centres.T).mean(0)
            best = np.argsort(-score, kind="stable")[:FIRST]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("pack")[i].as_py()] * len(best), pa.int64()), pa.array(blocks[best]), pa.array(score[best])], names=["pack", "block", "promise"])


def _alive(batch: pa.RecordBatch, i: int, asked: np.ndarray, blocks: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Whether a query's bound in a block reaches its floor; blocks done are left out."""
    floors = np.array(batch.column("floors")[i].as_py())
    radii = batch.column("radii")[i].values.to_numpy(zero_copy_only=False)
    bound = asked @ centres.T + np.linalg.norm(asked, axis=1)[:, None] * radii
    alive = bound + SLACK * (1 + np.abs(bound)) >= floors[:, None]
    alive[:, np.isin(blocks, batch.column("done")[i].values.to_numpy(zero_copy_only=False))] = False
    return alive


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, block, ids, matrix): the queries of a pack that are alive in a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, asked, blocks, centres = _rows_of(batch, i)
            alive = _alive(batch, i, asked, blocks, centres)
            for b in np.flatnonzero(alive.any(0)):
                own = np.flatnonzero(alive[:, b])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("pack")[i].as_py()], pa.int64()), pa.array([blocks[b]], pa.int64()), pa.array([ids[own].tolist()], pa.list_(pa.int64())), pa.array([asked[own].tobytes()], pa.binary())], names=["pack", "block", "ids", "matrix"])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n): the queries that ``_surviving`` would send to blocks, of each pack and map; no vector."""
    for batch in batches:
        for i in range(batch.num_rows):
            sent = _alive(batch, i, *_rows_of(batch, i)[1:]).sum()
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["n"])


def _scored(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pack, row, ref_id, score): the k best of one block for each query sent to it."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, refs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "ref_ids"))
                asked, held = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(n, -1) for c, n in (("matrix", len(ids)), ("ref_matrix", len(refs))))
                row, col, score = best_of(asked @ held.T, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), batch.column("pack")[i].as_py(), np.int64)), pa.array(ids[row]), pa.array(refs[col]), pa.array(score)], names=["pack", "row", "ref_id", "score"])

    return run


def topk_pruned(queries: DataFrame, refs: DataFrame, k: int, by: list[str] | None = None, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """J1's rows (by..., q, rank, ref_id, score), and one row (pairs, scored): pairs of pack and block, and those not skipped.

    Both sides as in ``topk_inner_product``; empty sides give no rows.
    """
    spark, by = queries.sparkSession, by or []
    asked = _held(queries.select(*by, "q", F.col("vec").cast("array<double>").alias("vec")).withColumn("row", F.monotonically_increasing_id()), "queries")
    held = refs.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("vec").cast("array<double>").alias("vec"))
    sample = held.orderBy(F.xxhash64("ref_id"), "ref_id").limit(int(min(PIVOTS, max(1, -(-held.count() // size))))).collect()
    pivots = np.array([r["vec"] for r in sample]) if sample else np.zeros((1, 1))
    blocks = _packs(held, "ref_id", pivots, size, "blocks")
    packs = _packs(asked if sample else asked.limit(0), "row", pivots, size, "packs")
    maps = _maps(blocks)
    n_maps = maps.count()
    on_maps = packs.withColumn("map", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_maps - 1))))).join(maps, "map")
    place = F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("promise"), "block"))
    first = _held(on_maps.select("pack", "ids", "matrix", "blocks", "centres").mapInArrow(_promising, "pack long, block long, promise double").withColumn("_p", place).where(F.col("_p") <= FIRST).select("pack", "block"), "first")
    side = blocks.select(F.col("pack").alias("block"), F.col("ids").alias("ref_ids"), F.col("matrix").alias("ref_matrix"))
    found = "pack long, row long, ref_id long, score double"
    one = _held(first.join(packs.select("pack", "ids", "matrix"), "pack").join(side, "block").select("pack", "ids", "matrix", "ref_ids", "ref_matrix").mapInArrow(_scored(k), found), "one")
    kth = one.withColumn("_p", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).where(F.col("_p") == k).select("row", F.col("score").alias("floor"))
    members = packs.select("pack", F.posexplode("ids").alias("at", "row")).join(kth, "row", "left")
    floors = members.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("floor", F.lit(float("-inf"))).alias("f")))), lambda s: s.f).alias("floors"))
    done = first.groupBy("pack").agg(F.collect_list("block").alias("done"))
    alive = on_maps.join(floors, "pack").join(done, "pack").select("pack", "ids", "matrix", "blocks", "centres", "radii", "floors", "done")
    n = packs.agg(F.count("*").alias("p")).crossJoin(blocks.agg(F.count("*").alias("b")))  # two single rows
    sent = alive.mapInArrow(_survivors, "n long").agg(F.sum("n")).first()[0] or 0
    if 2 * sent > asked.count() * blocks.count():  # bounds that skip little: every block for every query, without shipping them so often
        return topk_inner_product(asked, held, k, by), n.select((F.col("p") * F.col("b")).alias("pairs"), (F.col("p") * F.col("b")).alias("scored"))
    left = _held(alive.mapInArrow(_surviving, "pack long, block long, ids array<long>, matrix binary"), "left")
    two = left.join(side, "block").select("pack", "ids", "matrix", "ref_ids", "ref_matrix").mapInArrow(_scored(k), found)
    scores = one.unionAll(two).join(asked.select(*by, "q", "row"), "row").select(*by, "q", "ref_id", "score")
    counts = n.select((F.col("p") * F.col("b")).alias("pairs")).crossJoin(first.select("pack").unionAll(left.select("pack")).agg(F.count("*").alias("scored")))
    return ranked(scores, k, by), counts
