"""Substring dedup by compacting a de Bruijn graph of word k-mers.

The graph's edges are the WINDOW-word windows of the corpus, its nodes the
runs of one word less that two of them share. Edges that occur once are of no
interest, so they are dropped before the graph is built: a window's least
GRAM-word run, by hash, is equal in equal windows; runs that occur once in the
corpus rule out the windows on them by a count and a join.

1. Consecutive windows on one such run are an edge stretch; equal stretches
   are one path, with its end nodes and its places counted.
2. Where a repeated path ends in a node that no other path enters or leaves,
   the one that follows is joined to it: paths compact by Spark joins into
   unitigs (``compacted``), and a document's stretches into long spans.
3. Windows of the paths that occur once are compared one by one, which settles
   the ends of repeats.
4. Every span has a source: other coordinates (text, word) that should hold the
   same words. The words there are fetched and compared; only then do the span's
   words go.

Hashes only propose: should a comparison fail, all is done again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, distinct_texts, drop_staged, frees_shuffles, gram_hashes, gram_valid, paired, print_of, read_table, slide, staged, word_blocks

WINDOW = 35
GRAM = 10
#: Windows of a stretch, at most.
REACH = WINDOW - GRAM + 1
#: One path in CUT starts a unitig of its own, so that nearly all chains end within STEPS doubling steps.
CUT, STEPS = 32, 8


def window_runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run hashes, the least of each window, and whether each window lies inside one text."""
    grams = gram_hashes(words, GRAM)
    if len(words) < WINDOW:
        return grams, np.zeros(0, U64), np.zeros(0, bool)
    return grams, slide(grams, REACH, np.minimum), gram_valid(len(words), offsets, WINDOW)


def runs_of(texts: DataFrame, seed: int) -> DataFrame:
    """run, id, n: the least runs of the windows of every (id, copies, text), with their places counted."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, last, words, offsets in word_blocks(batch.column(2), seed):
                grams, least, valid = window_runs(words, offsets)
                if not valid.any():
                    continue
                pad = np.zeros(REACH - 1, U64)
                top = slide(np.concatenate([pad, np.where(valid, least, U64(0)), pad]), REACH, np.maximum)
                at = np.flatnonzero((top == grams) & (top > 0))
                owner = np.searchsorted(offsets, at, "right") - 1
                order = np.lexsort((grams[at], owner))
                keys, owner = grams[at][order], owner[order]
                new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
                count = np.diff(np.r_[new, len(keys)]) * np.minimum(copies[first:last][owner[new]], 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(ids[first:last][owner[new]]), pa.array(count.astype(np.int32))], names=["run", "id", "n"])

    return texts.select("id", "copies", "text").mapInArrow(find, "run long, id long, n int")


def stretches_of(texts: DataFrame, seed: int) -> DataFrame:
    """Stretches on the given runs of (id, copies, text, runs): run, path, size, head, tail, id, first, copies, windows.

    ``head`` and ``tail`` are the nodes before the first and after the last of
    its ``size`` edges; ``path`` stands for all its words.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            known = batch.column(3)
            for first, last, words, offsets in word_blocks(batch.column(2), seed):
                _, least, valid = window_runs(words, offsets)
                if not valid.any():
                    continue
                on = np.zeros(len(least), bool)
                for row in range(last - first):
                    lo, hi = int(offsets[row]), int(offsets[row + 1]) - WINDOW + 1
                    if hi > lo:
                        keys = np.sort(known[first + row].values.to_numpy(zero_copy_only=False).view(U64))
                        mine = least[lo:hi]
                        on[lo:hi] = keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine
                at = np.flatnonzero(on & valid)
                if not len(at):
                    continue
                owner = np.searchsorted(offsets, at, "right") - 1
                breaks = np.r_[True, (np.diff(at) != 1) | (least[at][1:] != least[at][:-1]) | (owner[1:] != owner[:-1])]
                begin = np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
                breaks |= (np.arange(len(at)) - begin) % REACH == 0
                new = np.flatnonzero(breaks)
                size = np.diff(np.r_[new, len(at)])
                start = at[new]
                edges, nodes = gram_hashes(words, WINDOW), gram_hashes(words, WINDOW - 1)
                # its first and last edge hold all words of a stretch, which is shorter than an edge
                path = paired(paired(edges[start], edges[start + size - 1]), size.astype(U64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[start].view(np.int64)),
                        pa.array(path.view(np.int64)),
                        pa.array(size.astype(np.int32)),
                        pa.array(nodes[start].view(np.int64)),
                        pa.array(nodes[start + size].view(np.int64)),
                        pa.array(ids[first:last][owner[new]]),
                        pa.array((start - offsets[owner[new]]).astype(np.int64)),
                        pa.array(copies[first:last][owner[new]]),
                        pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.array(edges[at].view(np.int64))),
                    ],
                    names=["run", "path", "size", "head", "tail", "id", "first", "copies", "windows"],
                )

    return texts.select("id", "copies", "text", "runs").mapInArrow(find, "run long, path long, size int, head long, tail long, id long, first long, copies long, windows array<long>")


def compacted(paths: DataFrame) -> DataFrame:
    """path, unitig (its first path) and offset (edges before the path) of every path that is in a unitig of two or more; staged.

    ``paths`` has path, size, head and tail of the repeated paths. A node that
    one path enters and one leaves joins them, unless the path after it is one of
    those that start anew. Pointers to the path before double in length each
    step; a circle, or a chain that has not ended after STEPS steps, is cut at
    the paths reached.
    """
    enters = paths.groupBy("tail").agg(F.count("*").alias("n"), F.min("path").alias("before"), F.min("size").alias("far")).where("n = 1")
    leaves = paths.groupBy("head").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    enters, leaves = staged(enters.drop("n"), "enters"), staged(leaves.drop("n"), "leaves")
    back = staged(leaves.join(enters, leaves["head"] == enters["tail"]).where((F.col("before") != F.col("path")) & (F.pmod(F.xxhash64("path"), F.lit(CUT)) != 0)).select("path", "before", F.col("far").cast("long").alias("offset")), "back")
    drop_staged(enters, leaves)
    for _ in range(STEPS):
        beyond = back.select(F.col("path").alias("before"), F.col("before").alias("root"), F.col("offset").alias("further"))
        # a circle comes back to its own path and stays there
        moves = F.col("root").isNotNull() & (F.col("root") != F.col("path"))
        longer = back.join(beyond, "before", "left").select("path", F.when(moves, F.col("root")).otherwise(F.col("before")).alias("before"), F.when(moves, F.col("offset") + F.col("further")).otherwise(F.col("offset")).alias("offset"), moves.alias("moved"))
        longer = staged(longer, "back")
        drop_staged(back)
        back = longer
        if not back.where("moved").limit(1).count():
            break
    roots = back.select(F.col("before").alias("path")).distinct().join(back.select("path"), "path", "left_anti").select("path", F.col("path").alias("unitig"), F.lit(0).cast("long").alias("offset"))
    out = staged(back.select("path", F.col("before").alias("unitig"), "offset").unionByName(roots), "unitigs")
    drop_staged(back)
    return out


def _other(own: Column, least: Column, most: Column) -> Column:
    """The least of the known coordinates that is not a row's own."""
    return F.when(least == own, most).otherwise(least)


def claims_of(texts: DataFrame, seed: int) -> DataFrame:
    """id, start, stop (words), source, at: spans that should equal the words from ``at`` on in text ``source``; staged.

    Only of texts that occur once: a text with copies repeats as a whole.
    """
    runs = staged(runs_of(texts, seed), "runs")
    # counts are staged before each join: a join straight on an aggregate shares its shuffle, and a hot key could not be split
    repeated = staged(runs.groupBy("run").agg(F.sum("n").alias("places")).where("places >= 2").select("run"), "repeated-runs")
    per_text = runs.select("run", "id").join(repeated, "run").groupBy("id").agg(F.collect_list("run").alias("runs"))
    stretches = staged(stretches_of(texts.join(per_text, "id"), seed), "stretches")
    drop_staged(runs, repeated)

    place = F.struct("id", "first")
    grouped = stretches.groupBy("run", "path", "size").agg(F.sum(F.least("copies", F.lit(2))).alias("places"), F.count("*").alias("rows"), F.min(place).alias("least"), F.max(place).alias("most"), F.first("head").alias("head"), F.first("tail").alias("tail"))
    paths = staged(grouped, "paths")
    unitigs = compacted(paths.where("places >= 2").groupBy("path").agg(F.first("size").alias("size"), F.first("head").alias("head"), F.first("tail").alias("tail")))

    met = stretches.where("copies = 1").select("run", "path", "size", "id", "first").join(paths.where("rows >= 2").select("run", "path", "size", "least", "most"), ["run", "path", "size"])
    # the stretches of one document that follow each other in a unitig are one long span
    placed = met.join(unitigs, "path", "left").select("id", F.coalesce("unitig", "path").alias("unitig"), (F.col("first") - F.coalesce("offset", F.lit(0))).alias("shift"), F.col("first").alias("start"), (F.col("first") + F.col("size") + (WINDOW - 1)).alias("stop"), _other(place, F.col("least"), F.col("most")).alias("from"))
    spans = _islands(placed, ["id", "unitig", "shift"]).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_list(F.struct("start", "stop", "from")).alias("parts"))
    spans = staged(spans, "spans")
    extent = ["unitig", F.col("start") - F.col("shift"), F.col("stop") - F.col("shift")]
    named = spans.select("id", "start", "stop", "parts", extent[0], extent[1].alias("lo"), extent[2].alias("hi"))
    where = F.struct("id", "start")
    whole = staged(named.groupBy("unitig", "lo", "hi").agg(F.min(where).alias("least"), F.max(where).alias("most")).where("least <> most"), "whole-spans")
    source = _other(where, F.col("least"), F.col("most"))
    both = named.join(whole, ["unitig", "lo", "hi"], "left")
    long = both.where("least is not null").select("id", "start", "stop", source.id.alias("source"), source.start.alias("at"))
    # a span of its own extent goes back to its parts, each of which occurs elsewhere
    each = both.where("least is null").select("id", F.explode("parts").alias("p"))
    parts = each.select("id", "p.start", "p.stop", F.col("p.from.id").alias("source"), F.col("p.from.first").alias("at"))

    one = F.struct("id", (F.col("first") + F.col("k")).alias("start"))
    ends = stretches.join(paths.select("run", "path", "size", "places", "least"), ["run", "path", "size"]).where((F.col("places") == 1) | (place == F.col("least")))
    ends = ends.select("run", "places", "id", "first", F.posexplode("windows").alias("k", "window"))
    twice = staged(ends.groupBy("run", "window").agg(F.sum("places").alias("seen"), F.min(one).alias("least"), F.max(one).alias("most")).where("seen >= 2").drop("seen"), "windows")
    single = ends.where("places = 1").select("run", "window", "id", one.alias("own")).join(twice, ["run", "window"])
    from_ = _other(F.col("own"), F.col("least"), F.col("most"))
    alone = single.select("id", F.col("own.start").alias("start"), (F.col("own.start") + WINDOW).alias("stop"), from_.id.alias("source"), from_.start.alias("at"))
    near = parts.unionByName(alone).withColumn("shift", F.col("at") - F.col("start"))
    joined = _islands(near, ["id", "source", "shift"]).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    out = staged(joined.select("id", "start", "stop", "source", (F.col("start") + F.col("shift")).alias("at")).unionByName(long), "claims")
    drop_staged(stretches, paths, unitigs, spans, whole, twice)
    return out


def _islands(rows: DataFrame, by: list[str]) -> GroupedData:
    """Rows (start, stop) grouped by ``by`` and by stretches of words without a gap."""
    line = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("start") <= before, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_island")


def with_words(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """id, start, n and words (joined by a space) of every claim: the n words found at its source; each place is read once."""
    asked = staged(claims.select("source", "at", (F.col("stop") - F.col("start")).alias("n")).distinct(), "sources")
    lists = asked.groupBy("source").agg(F.collect_list(F.struct("at", "n")).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                out: list[list] = [[], [], [], []]
                for source, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words = text.encode().split()
                    for w in wanted:
                        for col, v in zip(out, (source, w["at"], w["n"], b" ".join(words[w["at"] : w["at"] + w["n"]])), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["source", "at", "n", "words"])

    found = texts.select(F.col("id").alias("source"), "text").join(lists, "source").select("source", "text", "asked").mapInArrow(read, "source long, at long, n long, words binary")
    found = staged(found, "source-words")
    out = staged(claims.withColumn("n", F.col("stop") - F.col("start")).join(found, ["source", "at", "n"]).select("id", "start", "n", "words"), "claimed-words")
    drop_staged(asked, found)
    return out


def _cut(texts: DataFrame, proofs: DataFrame, with_text: bool) -> DataFrame:
    """print, n_words, n_removed, kept_sha256, wrong (claims whose words differ) and kept_text of every text."""
    lists = proofs.groupBy("id").agg(F.collect_list(F.struct("start", "n", "words")).alias("marks"))
    source = texts.select("id", "print", "copies", "text").join(lists, "id", "left").select("print", "copies", "text", "marks")
    fields = [("print", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("wrong", pa.int64())] + ([("kept_text", pa.string())] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                out: list[list] = [[] for _ in fields]
                for own, copies, text, marks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    words = text.encode().split()
                    wrong, gone = 0, 0
                    if copies > 1 and len(words) >= WINDOW:
                        kept, gone = [], len(words)
                    elif marks:
                        step = np.zeros(len(words) + 1, np.int64)
                        for m in marks:
                            if b" ".join(words[m["start"] : m["start"] + m["n"]]) == m["words"]:
                                step[m["start"]] += 1
                                step[m["start"] + m["n"]] -= 1
                            else:
                                wrong += 1
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) <= 0).tolist()]
                        gone = len(words) - len(kept)
                    else:
                        kept = words
                    left = b" ".join(kept)
                    values = [own, len(words), gone, hashlib.sha256(left).hexdigest(), wrong] + ([left.decode() if gone else text] if with_text else [])
                    for col, v in zip(out, values, strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    return source.mapInArrow(run, "print binary, n_words long, n_removed long, kept_sha256 string, wrong long" + (", kept_text string" if with_text else ""))


def dedup(docs: DataFrame, keep: list[str], texts: bool = False) -> DataFrame:
    """``keep`` columns, n_words, n_removed and kept_sha256 of every row; with ``texts`` the kept text too.

    ``docs`` has doc_id and text, any other columns are ``keep``'s, which must
    not name an added one. Null and empty texts have no words and stay as they
    are. Repeated rows are copies of each other: all their windows repeat. A
    text of any length is one row, hashed in blocks. The kept text joins the
    kept words by one space; a row that loses nothing keeps its text unchanged
    (the digest is over the words either way). Rows are told apart by their
    text, never by position, so a lost executor changes nothing.
    """
    if {"n_words", "n_removed", "kept_sha256", "kept_text"} & set(keep):
        raise ValueError("keep names a column that is added")
    with frees_shuffles(docs.sparkSession):
        each = distinct_texts(docs.select("doc_id", "text"))
        seed = 0
        while True:
            claims = claims_of(each, seed)
            proofs = with_words(claims, each)
            cut = staged(_cut(each, proofs, texts), "cut")
            drop_staged(claims, proofs)
            if not cut.where("wrong > 0").limit(1).count():
                break
            drop_staged(cut)
            seed += 1
        drop_staged(each)
    added = ["n_words", "n_removed", "kept_sha256"]
    source = docs.select(*keep, print_of(F.col("text")).alias("_print"), *([F.col("text").isNull().alias("_none")] if texts else []))
    found = source.join(cut.select(F.col("print").alias("_print"), *added, *([F.col("kept_text").alias("_kept")] if texts else [])), "_print")
    return found.select(*keep, *added, *([F.when(~F.col("_none"), F.col("_kept")).alias("kept_text")] if texts else []))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"), ["doc_id"])
