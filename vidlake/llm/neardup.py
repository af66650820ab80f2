"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Shingles are SHINGLE-word runs (a text of fewer words, but not none, is one
shingle). The leaves of each of TREES prefix tries are the texts, under DEPTH
min-hash values each; a node is the set of leaves that share a prefix.

1. At full depth, the texts below each node are verified against the node's
   first text; links join texts into classes.
2. The similarities found say how many links prefixes of each length can be
   expected to miss (``shortened``): the matched prefix is shortened to the
   longest that reaches the target recall, and its nodes are verified likewise.
3. Below nodes that still hold texts of different classes, all pairs across
   classes are verified, so classes do not depend on who came first.
4. Links are counted inside each class, where all of them lie.

Verification is on the words themselves. No step emits a row by pair: steps 1
and 2 send a text once for each first text that it meets, 3 once for each such
node, 4 once, times the blocks of the node or class. A block holds
BLOCK_SHINGLES, so only a group beyond that is sent more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, distinct_texts, drop_staged, exact_runs, frees_shuffles, gram_hashes, gram_valid, mix, print_of, read_table, split_words, staged, word_blocks

SHINGLE = 5
#: Similarity NUM / DEN or more links two texts.
NUM, DEN = 4, 5
TREES, DEPTH, TARGET = 32, 8, 0.9999
#: Shingles of a block, about: the memory of one task, two blocks at a time.
BLOCK_SHINGLES = 1_000_000
#: Texts verified against one first text by a task.
MEMBERS = 4096
#: Texts of a side of one matrix product.
SIDE = 256
#: Bytes of a stored min-hash value.
WIDE = 2


def found_at(similarity: np.ndarray | float, prefix: int, trees: int = TREES) -> np.ndarray | float:
    """The chance that two texts of a similarity share a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def shortened(histogram: dict[float, int], found: int, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix whose expected recall reaches the target, by the links found at prefix ``found``.

    Each link found stands for 1 / (its chance of being found) links. One more
    link at the threshold itself is assumed, so that few links prove nothing.
    """
    levels = np.array([*histogram, NUM / DEN])
    weight = np.array([*histogram.values(), 1.0]) / np.r_[found_at(levels[:-1], found), 1.0]
    for k in range(depth, 1, -1):
        if (weight * found_at(levels, k)).sum() >= target * weight.sum():
            return k
    return 1


def shingle_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, offsets by row) over blocks of whole rows."""
    for first, last, words, offsets in word_blocks(column):
        sizes = np.diff(offsets)
        parts, owners = [], []
        for k in range(1, SHINGLE + 1):
            grams = gram_hashes(words, k)
            if k < SHINGLE:
                own = np.flatnonzero(sizes == k)
                parts.append(grams[offsets[own]] if len(own) else grams[:0])
            else:
                at = np.flatnonzero(gram_valid(len(words), offsets, k))
                own = np.searchsorted(offsets, at, "right") - 1
                parts.append(grams[at])
            owners.append(own)
        hashes, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        yield first, last, hashes[order], np.searchsorted(owner[order], np.arange(last - first + 1))


def min_hashes(hashes: np.ndarray, offsets: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows with shingles, and their values (rows x trees x depth), WIDE bytes each."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    values = np.zeros((len(rows), trees * depth), np.uint16)
    if len(rows):
        seeds = mix(np.arange(1, 2 * trees * depth + 1, dtype=U64))
        starts = offsets[rows]
        for k in range(trees * depth):
            least = np.minimum.reduceat((hashes ^ seeds[2 * k]) * (seeds[2 * k + 1] | U64(1)), starts)
            values[:, k] = (mix(least) >> U64(48)).astype(np.uint16)
    return rows, values.reshape(len(rows), trees, depth)


def signatures(texts: DataFrame) -> DataFrame:
    """id, size (shingles, repeats included) and sig (the values of all trees) of every (id, text) with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, hashes, offsets in shingle_blocks(batch.column(1)):
                rows, values = min_hashes(hashes, offsets)
                if len(rows):
                    sig = pa.array([v.astype(">u2").tobytes() for v in values], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first:last][rows]), pa.array(np.diff(offsets)[rows].astype(np.int64)), sig], names=["id", "size", "sig"])

    return texts.select("id", "text").mapInArrow(run, "id long, size long, sig binary")


def leaves(signed: DataFrame, prefix: int) -> DataFrame:
    """id, size, label and the node (tree and prefix, hashed: a false match is one more candidate) of each text in each tree."""
    node = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("sig", t * (DEPTH * WIDE) + 1, F.lit(prefix * WIDE))))
    return signed.select("id", "size", "label", F.explode(node).alias("node"))


def exact_shingles(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers, equal for equal words and no others in ``texts``."""
    words, offsets = split_words(texts)
    ids, grams = exact_runs(words)
    sizes = np.diff(offsets)
    few: dict[tuple, int] = {}
    out = []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if sizes[row] >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif sizes[row]:
            out.append(np.array([-1 - few.setdefault(tuple(ids[a:b].tolist()), len(few))]))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair of ``left`` and ``right`` (positions of sets) reaches the threshold, exactly.

    Counts shared shingles by products of 0/1 matrices over slices of those that two sets hold at least.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    both = np.concatenate([left, right])
    flat = np.concatenate([sets[i] for i in both])
    owner = np.repeat(np.arange(len(both)), sizes[both])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    group = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    shared = np.bincount(group)[group] > 1
    owner, group = owner[shared], group[shared]
    column = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if len(group) else group
    total = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        held = np.zeros((len(both), min(width, int(column[-1]) + 1 - lo)), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        total += held[: len(left)] @ held[len(left) :].T
    common = total.astype(np.int64)
    return (DEN * common >= NUM * (sizes[left][:, None] + sizes[right][None, :] - common)) & (common > 0)


def pairs_of_tile(block: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Sides of at most SIDE positions that cover the pairs of blocks i and j, and whether both are one side."""
    first, second = (np.flatnonzero(block == b) for b in (i, j))
    left, right = ([x[k : k + SIDE] for k in range(0, len(x), SIDE)] for x in (first, second))
    for k, x in enumerate(left):
        for n, y in enumerate(right):
            if i != j or n >= k:
                yield x, y, i == j and n == k


def streamed(rows: DataFrame, by: list[str], order: list[str], done: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``done`` of the rows of each ``by``, which come together by a shuffle and a sort; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            marks = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(by))]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                own = tuple(m[a] for m in marks)
                if held and own != key:
                    out = done(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
                key = own
                held.append(batch.slice(a, b - a))
        if held and (out := done(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _shingle_sets(text: bytes) -> set:
    w = text.split()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def against_first(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b (labels of text and first text), near (common / union) of the linked rows of ``pairs`` (id, label, first, first_label)."""
    # a first text of very many members is sent to several tasks
    many = staged(pairs.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS), "first-texts")
    part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS))).cast("int")
    dealt = staged(pairs.join(many, "first", "left").select("first", "first_label", part.alias("part"), "id", "label"), "pairs")
    drop_staged(many)
    heads = dealt.select("first", "part").distinct()
    body = texts.select("id", "text")
    members = dealt.join(body.hint("merge"), "id").select("first", "part", F.lit(1).alias("side"), "label", "first_label", "text")
    firsts = heads.join(body.withColumnRenamed("id", "first").hint("merge"), "first").select("first", "part", F.lit(0).alias("side"), F.lit(0).cast("long").alias("label"), F.lit(0).cast("long").alias("first_label"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: set = set()
        for whole in batches:
            for batch in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                out: list[list] = [[], [], []]
                for side, label, first_label, text in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                    own = _shingle_sets(text.encode())
                    if side == 0:
                        head = own
                        continue
                    both = len(own & head)
                    union = len(own) + len(head) - both
                    if both and DEN * both >= NUM * union:
                        for col, v in zip(out, (label, first_label, both / union), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "near"])

    rows = members.unionByName(firsts).repartition("first", "part").sortWithinPartitions("first", "part", "side")
    found = staged(rows.mapInArrow(run, "a long, b long, near double"), "star-links")
    drop_staged(dealt)
    return found


def star(signed: DataFrame, texts: DataFrame, prefix: int) -> DataFrame:
    """Links between the texts below each node and the node's first text, where their classes differ; staged."""
    own = leaves(signed, prefix)
    least = F.min(F.struct("label", "id")).alias("least")
    nodes = own.groupBy("node").agg(least, F.max("label").alias("most")).where(F.col("least.label") < F.col("most")).select("node", F.col("least.id").alias("first"), F.col("least.label").alias("first_label"))
    nodes = staged(nodes, "nodes")
    met = own.join(nodes, "node").where("label <> first_label").groupBy("id", "first").agg(F.first("label").alias("label"), F.first("first_label").alias("first_label"))
    pairs = staged(met, "met")
    drop_staged(nodes)
    found = against_first(pairs, texts)
    drop_staged(pairs)
    return found


def blocks_of(weight: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / BLOCK_SHINGLES)).cast("int")


def in_tiles(members: DataFrame, by: str) -> DataFrame:
    """Rows of (by, blocks, id, ...) once for each pair of blocks that holds their own: adds i <= j and block."""
    block = F.pmod(F.xxhash64("id", by), F.col("blocks")).cast("int")
    other = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def across(signed: DataFrame, texts: DataFrame, prefix: int) -> DataFrame:
    """Links between texts of different classes below one node, all pairs; staged as (a, b) labels."""
    own = leaves(signed, prefix)
    nodes = own.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    nodes = nodes.where("lo < hi").groupBy("n", "weight", "x", "y").agg(F.min("node").alias("node")).select("node", blocks_of(F.col("weight")).alias("blocks"))
    nodes = staged(nodes, "open-nodes")
    members = staged(in_tiles(own.join(nodes, "node").select("node", "blocks", "id", "label"), "node"), "members")
    drop_staged(nodes)

    def done(rows: pa.Table) -> pa.RecordBatch | None:
        label = rows["label"].to_numpy().astype(np.int64)
        order = np.argsort(label, kind="stable")
        label = label[order]
        sets = exact_shingles(rows["text"].combine_chunks().take(pa.array(order)))
        found = []
        for x, y, _ in pairs_of_tile(rows["block"].to_numpy()[order], rows["i"][0].as_py(), rows["j"][0].as_py()):
            if label[x[0]] == label[x[-1]] == label[y[0]] == label[y[-1]]:
                continue
            near = linked(sets, x, y) & (label[x][:, None] != label[y][None, :])
            p, q = np.nonzero(near)
            if len(p):
                found.append(np.unique(np.stack([label[x[p]], label[y[q]]], axis=1), axis=0))
        if not found:
            return None
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    rows = members.join(texts.select("id", "text").hint("merge"), "id").select("node", "i", "j", "block", "label", "text")
    found = staged(streamed(rows, ["node", "i", "j"], [], done, "a long, b long"), "cross-links")
    drop_staged(members)
    return found


def components(edges: DataFrame) -> DataFrame:
    """v, label: the least vertex of each connected component of (a, b) edges, staged.

    Least labels pass along edges and jump to their label's label each round,
    so rounds grow with the logarithm of a component's diameter in most cases.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("least"))
        nearer = labels.join(seen, labels["v"] == seen["a"]).select("v", "label", F.least("label", "least").alias("best"))
        up = labels.select(F.col("v").alias("best"), F.col("label").alias("beyond"))
        moved = staged(nearer.join(up, "best", "left").select("v", "label", F.least("best", "beyond").alias("best")), "labels")
        changed = moved.where("best < label").limit(1).count()
        drop_staged(labels)
        labels = moved.select("v", F.col("best").alias("label"))
        labels.staged_at = moved.staged_at
        if not changed:
            drop_staged(both)
            return labels


def merged(signed: DataFrame, links: DataFrame) -> DataFrame:
    """``signed`` with the labels that ``links`` (a, b: labels) join set to the least of them; staged. ``signed`` and ``links`` go."""
    if links.limit(1).count():
        joined = components(links)
        out = staged(signed.join(joined.withColumnRenamed("label", "least"), signed["label"] == joined["v"], "left").select("id", "size", "sig", F.coalesce("least", "label").alias("label")), "labelled")
        drop_staged(joined, signed)
        signed = out
    drop_staged(links)
    return signed


def classes(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """id, label, links (by copies) of every text in a class of two texts or more; staged. Links are exact."""
    sizes = signed.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1").select("label", blocks_of(F.col("weight")).alias("blocks"))
    sizes = staged(sizes, "class-sizes")
    members = staged(in_tiles(signed.select("id", "label").join(sizes, "label"), "label"), "class-members")
    drop_staged(sizes)

    def done(rows: pa.Table) -> pa.RecordBatch:
        sets = exact_shingles(rows["text"].combine_chunks())
        copies = rows["copies"].to_numpy().astype(np.int64)
        links = np.zeros(len(sets), np.int64)
        for x, y, same in pairs_of_tile(rows["block"].to_numpy(), rows["i"][0].as_py(), rows["j"][0].as_py()):
            near = linked(sets, x, y)
            if same:
                near &= ~np.eye(len(x), dtype=bool)
                links[x] += near @ copies[y]
            else:
                links[x] += near @ copies[y]
                links[y] += copies[x] @ near
        return pa.RecordBatch.from_arrays([rows["id"].combine_chunks(), rows["label"].combine_chunks(), pa.array(links)], names=["id", "label", "links"])

    rows = members.join(texts.select("id", "text", "copies").hint("merge"), "id").select("label", "i", "j", "block", "id", "copies", "text")
    found = streamed(rows, ["label", "i", "j"], [], done, "id long, label long, links long")
    out = staged(found.groupBy("id").agg(F.first("label").alias("label"), F.sum("links").alias("links")), "classes")
    drop_staged(members)
    return out


def near_duplicates(docs: DataFrame, keep: list[str], mark_kept: bool = True) -> DataFrame:
    """``keep`` columns, class_id, n_links, and with ``mark_kept`` ``is_kept`` for one row of each class, of the least doc_id.

    ``docs`` has doc_id and text; ``keep`` must not name an added column. A
    class joins equal texts and texts linked by Jaccard >= NUM / DEN,
    transitively; class_id is its least doc_id (null if all are null) and
    n_links counts the other rows that a row is equal to or linked with. Null
    texts are empty; texts without a word are linked only with equal ones. Of
    rows with equal doc_id and text any one may be the kept one. Texts of any
    length are compared whole. Rows are told apart by their text alone, never
    by position, so a lost executor changes nothing.
    """
    if {"class_id", "n_links", "is_kept"} & set(keep):
        raise ValueError("keep names a column that is added")
    with frees_shuffles(docs.sparkSession):
        texts, found = _classes(docs)
        least = F.min(F.struct(F.col("first.none").alias("none"), F.col("first.doc_id").alias("doc_id"), "print")).alias("least")
        own = found.join(texts.select("id", "print", "first"), "id")
        kept = own.groupBy("label").agg(least)
        own = own.join(kept, "label").select("id", "links", "least")
        rows = texts.drop("text").join(own, "id", "left").select(
            F.col("print").alias("_print"),
            F.coalesce(F.col("least.doc_id"), F.when(F.col("least").isNull(), F.col("first.doc_id"))).alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce(F.col("least.print") == F.col("print"), F.lit(True)).alias("_kept"),
        )
        answer = staged(rows, "answer")
        drop_staged(texts, found)
    source = docs.select(*keep, F.col("doc_id").alias("_id"), print_of(F.col("text")).alias("_print")).join(answer, "_print")
    if not mark_kept:
        return source.select(*keep, "class_id", "n_links")
    # the class's least doc_id is that of a row of the kept text; among equal rows the first of a window is taken
    able = F.col("_kept") & F.col("_id").eqNullSafe(F.col("class_id"))
    rest = source.where(~able).select(*keep, "class_id", "n_links", F.lit(False).alias("is_kept"))
    first = F.row_number().over(Window.partitionBy("_print").orderBy("_id")) == 1
    return source.where(able).select(*keep, "class_id", "n_links", first.alias("is_kept")).unionByName(rest)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged texts of ``docs``, and id, label, links of those in a class."""
    texts = distinct_texts(docs.select("doc_id", "text"))
    signed = staged(signatures(texts).withColumn("label", F.col("id")), "signatures")
    links = star(signed, texts, DEPTH)
    # at most a row for each hundredth of similarity
    seen = {r["near"]: r["n"] for r in links.groupBy(F.round(F.floor(F.col("near") * 100) / 100, 2).alias("near")).agg(F.count("*").alias("n")).collect()}
    prefix = shortened(seen, DEPTH)
    signed = merged(signed, links)
    if prefix < DEPTH:
        signed = merged(signed, star(signed, texts, prefix))
    signed = merged(signed, across(signed, texts, prefix))
    found = classes(signed, texts)
    drop_staged(signed)
    return texts, found


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), ["doc_id"], mark_kept=False)
