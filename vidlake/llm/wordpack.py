"""Token-id shards in Simple-8b: 64-bit words of a 4-bit selector and 60 data bits.

Shard file layout (little-endian): magic ``S8B1``; then blocks of whole or
partial documents, each ``u32 n_ids, u32 n_words, u32 n_escapes`` followed by
the words, then escape values (u64); then a footer: per document
``i64 doc_id, i64 n_tokens, u32 crc32, u32 flags`` (flag 1: null id), the byte
offset of each block (u64), and ``u64 n_blocks, u64 n_docs, u64 footer start``
with the magic again. Ids of one document may span blocks. An id of 60 bits or more is packed as 0 and kept
whole among the block's escapes, whose positions follow as u32.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, new_folder, read_table

MAGIC = b"S8B1"
END_ID = 2
BLOCK_IDS = 1 << 15
#: Bytes of text in a shard, as far as MAX_SHARDS of them hold the table.
SHARD_TEXT_BYTES = 16 << 20
MAX_SHARDS = 20_000
_LEAST = -(1 << 63)
#: Selector -> (ids in a word, bits of each): the published Simple-8b table, fixed values in order.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
LIMIT = 1 << 60


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escape positions and escape values of one block of unsigned ids.

    Each word takes the longest run that one selector holds. Runs past the end
    are padded with zeros, so a reader needs the block's id count.
    """
    ids = np.asarray(ids, np.uint64)
    over = np.flatnonzero(ids >= np.uint64(LIMIT))
    plain = ids.copy()
    plain[over] = 0
    n = len(plain)
    if not n:
        return np.zeros(0, np.uint64), over.astype(np.uint32), ids[over]
    if plain.max() < 1 << 53:
        bits = np.frexp(plain.astype(np.float64))[1].astype(np.int64)
    else:
        bits = np.array([int(x).bit_length() for x in plain.tolist()], np.int64)
    padded = np.r_[bits, np.zeros(240, np.int64)]
    best = np.full(n, 15, np.int64)
    sizes: dict[int, np.ndarray] = {}
    top, width = padded, 1
    for selector in range(15, -1, -1):
        count, room = SELECTORS[selector]
        while width < count:
            step = min(width, count - width)
            top = np.maximum(top[: len(top) - step], top[step:])
            width += step
        sizes[selector] = top
        best[top[:n] <= room] = selector
    jump = np.array([c for c, _ in SELECTORS])[best].tolist()
    at, k = [], 0
    while k < n:
        at.append(k)
        k += jump[k]
    starts = np.array(at)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    values = np.r_[plain, np.zeros(240, np.uint64)]
    for selector in np.unique(chosen):
        count, room = SELECTORS[selector]
        mine = np.flatnonzero(chosen == selector)
        if room:
            block = values[starts[mine][:, None] + np.arange(count)]
            words[mine] |= np.bitwise_or.reduce(block << (np.arange(count) * room).astype(np.uint64), axis=1)
    return words, over.astype(np.uint32), ids[over]


def unpack(words: np.ndarray, n_ids: int, where: np.ndarray = (), escapes: np.ndarray = ()) -> np.ndarray:
    """Vectorised decoding: one gather per selector."""
    counts = np.array([c for c, _ in SELECTORS])
    chosen = (words >> np.uint64(60)).astype(np.int64)
    starts = np.r_[0, np.cumsum(counts[chosen])]
    out = np.zeros(int(starts[-1]), np.uint64)
    for selector in np.unique(chosen):
        count, room = SELECTORS[selector]
        if room:
            mine = np.flatnonzero(chosen == selector)
            lanes = (words[mine][:, None] >> (np.arange(count) * room).astype(np.uint64)) & np.uint64((1 << room) - 1)
            out[starts[mine][:, None] + np.arange(count)] = lanes
    out = out[:n_ids]
    if len(where):
        out[where] = escapes
    return out


class ShardWriter:
    """Streams documents to one shard: at most one block of ids is held."""

    def __init__(self, out):
        self.out, self.size, self.blocks, self.docs = out, 0, [], []
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_id is None))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for k in range(0, stop, BLOCK_IDS):
            part = ids[k : min(stop, k + BLOCK_IDS)]
            words, where, escapes = pack(part)
            self.blocks.append(self.size)
            self._put(struct.pack("<III", len(part), len(words), len(escapes)) + words.astype("<u8").tobytes() + where.astype("<u4").tobytes() + escapes.astype("<u8").tobytes())
        self.held = [ids[stop:]]
        self.n_held = len(ids) - stop

    def close(self) -> int:
        self._flush(True)
        footer = self.size
        for doc in self.docs:
            self._put(struct.pack("<qqII", *doc))
        self._put(np.array(self.blocks, "<u8").tobytes())
        self._put(struct.pack("<QQQ", len(self.blocks), len(self.docs), footer) + MAGIC)
        return sum(n for _, n, _, _ in self.docs)


def read_shard(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in file order; ``file`` seeks. Blocks are found by the footer's offsets."""
    size = file.seek(0, 2)
    file.seek(size - 28)
    tail = file.read(28)
    n_blocks, n_docs, footer = struct.unpack("<QQQ", tail[:24])
    if tail[24:] != MAGIC:
        raise ValueError("not a shard file")
    file.seek(footer)
    docs = np.frombuffer(file.read(24 * n_docs), np.dtype([("id", "<i8"), ("n", "<i8"), ("crc", "<u4"), ("null", "<u4")]))
    blocks = np.frombuffer(file.read(8 * n_blocks), "<u8").tolist()
    held, k = np.zeros(0, np.uint64), 0
    for doc in docs:
        parts, need = [held[: int(doc["n"])]], int(doc["n"]) - len(held)
        held = held[int(doc["n"]) :]
        while need > 0:
            file.seek(blocks[k])
            k += 1
            n, w, e = struct.unpack("<III", file.read(12))
            words = np.frombuffer(file.read(8 * w), "<u8")
            where = np.frombuffer(file.read(4 * e), "<u4")
            ids = unpack(words, n, where, np.frombuffer(file.read(8 * e), "<u8"))
            parts.append(ids[:need])
            held = ids[need:]
            need -= n
        ids = np.concatenate(parts)
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(doc["crc"]):
            raise ValueError(f"document {doc['id']}: its ids do not match their checksum")
        yield None if doc["null"] else int(doc["id"]), ids


_CACHE_PARTS = 500_000
_JOINED = 1 << 14
#: Kinds of characters: ASCII white space, wider white space, letters and digits, marks.
_BLANK, _WIDE, _WORD, _MARK = 1, 2, 3, 4
#: Marks of ASCII; an apostrophe is none, as it may begin a contraction.
_MARKS = ",.;:!?*#$%&|)"
#: White space outside ASCII (fixed by Unicode): a run of white space may go on across it.
_WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDS_BLANK = (*"\t\n\x0b\x0c\r ", *map(chr, _WIDE_SPACE))
_BLANK_BYTES = tuple(c.encode() for c in _ENDS_BLANK)
_ODD_STARTS = tuple(c.encode() for c in _ENDS_BLANK if c not in " \n")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kinds by code point, up to the last of four-byte characters, which have none.

    Outside ASCII, letters, digits and marks are those that Unicode 3.2 and
    this Python's Unicode agree on, so that the pattern's engine, which is of a
    version between, must agree too.
    """
    out = np.zeros(0x10001, np.uint8)
    for c in range(0x80, 0x10000):
        new, old = unicodedata.category(chr(c))[0], unicodedata.ucd_3_2_0.category(chr(c))[0]
        out[c] = _WORD if new in "LN" and old in "LN" else _MARK if new in "PS" and old in "PS" else 0
    out[_WIDE_SPACE] = _WIDE
    out[[ord(c) for c in "\t\n\x0b\x0c\r "]] = _BLANK
    out[[c for c in range(0x80) if chr(c).isalnum()]] = _WORD
    out[list(map(ord, _MARKS))] = _MARK
    return out


def part_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """First bytes of the parts of texts laid end to end; ``rows`` are the first bytes of the texts.

    A part starts at ASCII white space after anything but white space, and at a
    mark after a letter or digit: both are piece boundaries of the byte-level
    pattern in any text (no piece holds white space after another character,
    none goes on from a letter or digit to a mark), so parts encode alone as
    within the text.
    """
    kinds = _kinds()
    first = np.where(data < 0x80, kinds[:256][data], 0).astype(np.uint8)
    last = first.copy()
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [np.r_[data, np.zeros(3, np.uint8)][lead + k].astype(np.int64) for k in range(3)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        point = np.where(size == 2, (b[0] & 0x1F) << 6 | b[1] & 0x3F, np.where(size == 3, (b[0] & 0xF) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F, 0x10000))
        first[lead] = last[lead + size - 1] = kinds[point]
    cut = np.zeros(len(data), bool)
    cut[1:] = (first[1:] == _BLANK) & (last[:-1] != _BLANK) & (last[:-1] != _WIDE) | (first[1:] == _MARK) & (last[:-1] == _WORD)
    cut[rows[rows < len(data)]] = True
    return np.flatnonzero(cut)


class CachedEncoder:
    """The tokenizers library, asked once for each distinct part of the texts.

    New parts are encoded side by side in long strings, each after a provable
    boundary (a line feed where it has no white space of its own), and their
    ids are told apart by the bytes of their tokens. Parts are looked up by
    their own bytes. A text that holds an added token's string is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))  # one character stands for one byte
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first = self.count = np.zeros(0, np.int64)

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_new(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that neither end in white space nor start with a rarer one, end to end, and how many each has."""
        before = [b"" if p[0] in b" \n" else b"\n" for p in parts]
        line = b"".join([x for both in zip(before, parts, strict=True) for x in both])
        sizes, added = (np.fromiter(map(len, x), np.int64, len(parts)) for x in (parts, before))
        ends = np.cumsum(sizes + added)
        begin = ends - sizes
        edges = np.unique(np.r_[0, ends[np.searchsorted(ends, np.arange(_JOINED, len(line), _JOINED))], len(line)]).tolist()
        found = self.tokenizer.encode_batch_fast([line[x:y].decode() for x, y in zip(edges, edges[1:], strict=False)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(f.ids, np.uint32) for f in found)])
        reach = np.r_[0, np.cumsum(self.sizes[ids])]
        first, stop = np.searchsorted(reach, begin), np.searchsorted(reach, ends)
        feeds = first[added == 1] - 1
        if not (np.array_equal(reach[first], begin) and np.array_equal(reach[stop], ends) and np.array_equal(reach[feeds], begin[added == 1] - 1)):
            raise AssertionError("parts did not end at token ends")
        keep = np.ones(len(ids), bool)
        keep[feeds] = False
        return ids[keep], stop - first

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        mine: list[int] = []
        for k, text in enumerate(texts):
            if any(a in text for a in self.added):
                out[k] = np.append(self._alone(text), np.uint32(END_ID))
            else:
                mine.append(k)
        raw = [texts[k].encode() for k in mine]
        lo, held = 0, 0
        for hi, piece in enumerate(raw, 1):
            held += len(piece)
            if held > 16 * BLOCK_BYTES or hi == len(raw):
                for k, ids in zip(mine[lo:hi], self._encode_block(raw[lo:hi]), strict=True):
                    out[k] = ids
                lo, held = hi, 0
        return out

    def _encode_block(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"".join(texts)
        rows = np.cumsum([0, *map(len, texts)])
        starts = part_starts(np.frombuffer(data, np.uint8), rows[:-1])
        at = np.r_[starts, len(data)]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        parts = coded.dictionary.to_pylist()
        if len(self.slots) > _CACHE_PARTS:
            self._forget()
        held = list(map(self.slots.get, parts))
        if None in held:
            new = [p for p, k in zip(parts, held, strict=True) if k is None]
            apart = {p for p in new if p.endswith(_BLANK_BYTES) or p.startswith(_ODD_STARTS)}
            ids, counts = self._encode_new([p for p in new if p not in apart])
            own = [self._alone(p.decode()) for p in new if p in apart]
            counts = np.r_[counts, np.fromiter(map(len, own), np.int64, len(own))]
            ids = np.concatenate([ids, *own])
            new = [p for p in new if p not in apart] + [p for p in new if p in apart]
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
            self.first = np.r_[self.first, len(self.ids) + np.cumsum(counts) - counts]
            self.count = np.r_[self.count, counts]
            self.ids = np.r_[self.ids, ids]
            held = list(map(self.slots.__getitem__, parts))
        slot = np.array(held, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.count[slot]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(self.first[slot] - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)]
        cut = np.r_[0, total][np.searchsorted(starts, rows)].tolist()
        end = np.array([END_ID], np.uint32)
        return [np.concatenate([ids[x:y], end]) for x, y in zip(cut, cut[1:], strict=False)]


@lru_cache(maxsize=1)
def encoder(path: str) -> CachedEncoder:
    """One encoder a Python worker: what it has learnt serves the worker's later tasks."""
    return CachedEncoder(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder that Spark has named with its scheme; Hadoop's names of S3 are one to it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri) if "://" in uri else re.sub(r"^(file:)?/*", "file:///", uri))


def shard_bounds(docs: DataFrame) -> np.ndarray:
    """The doc_ids at which shards end, from a sample of about 100 ids a shard; a null id counts as the least long."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    n = min(max(-(-(size["bytes"] or 0) // SHARD_TEXT_BYTES), 1), MAX_SHARDS)
    if n == 1:
        return np.zeros(0, np.int64)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"))
    # at most about 100 ids a shard, 2 million in all
    drawn = keys.sample(min(1.0, 100 * n / size["n"]), seed=17).toArrow().column(0).to_numpy()
    return np.sort(drawn)[np.arange(1, n) * len(drawn) // n] if len(drawn) else np.zeros(0, np.int64)


def encoded(docs: DataFrame, tokenizer_path: str, bounds: np.ndarray) -> DataFrame:
    """shard, doc_id, n, crc and ids (with the end id; two bytes each where all fit, else four) of every row.

    A row whose id lies at one bound or more goes to any of the shards that
    touch there, dealt by its place in its task, so one id held by any share
    of the rows fills as many shards as it needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        place = TaskContext.get().partitionId()
        for batch in batches:
            for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
                ids = coder.encode(part.column(1).to_pylist())
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                raw = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids]
                at = part.column(0).fill_null(_LEAST).to_numpy()
                low, high = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
                shard = low + (place + np.arange(len(at))) % (high - low + 1)
                place += len(at)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())], names=["shard", "doc_id", "n", "crc", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "shard int, doc_id long, n long, crc long, ids binary")


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str | None = None) -> list:
    """Encode ``docs`` and write it in ascending doc_id order to shards of ``folder``; returns (shard, file, docs, ids) rows.

    Each task writes one shard under a name of its own attempt and reports it,
    so a retried task never mixes with its first try: readers open only
    reported files. Texts of any length are encoded whole and once; what is
    sorted is their ids. Null ids come first, level with the least long; rows
    of equal ids go in any order, by token count and checksum inside a shard,
    so no id is bound to one shard; a null text is empty and holds only the
    end id. Other columns are not read. ``docs`` is a stored table: a retried
    task must see its rows in the same order.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    bounds = shard_bounds(docs)
    dealt = encoded(docs, path, bounds).repartitionById(len(bounds) + 1, "shard")
    ordered = dealt.sortWithinPartitions("doc_id", "n", "crc").select("doc_id", "ids", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.s8b"
        store, base = open_store(folder)
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(out)
            for doc_id, ids, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                writer.add(doc_id, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32))
        if writer:
            total = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [total]}, schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # one row a shard: bounded by MAX_SHARDS
    return sorted(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_ids long").collect())


def read_shards(spark: SparkSession, folder: str, shards: list) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    jobs, start = [], 0
    for row in shards:
        jobs.append((row["file"], start))
        start += row["n_ids"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    if not jobs:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(jobs, "file string, start long").repartition(len(jobs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, base = open_store(folder)
                with store.open_input_file(f"{base}/{file}") as opened:
                    rows: list[tuple] = []
                    for doc_id, ids in read_shard(opened):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _documents(rows, schema.names)
                            rows = []
                    yield _documents(rows, schema.names)

    return listed.mapInArrow(run, schema)


def _documents(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=names)


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "ids")
    return read_shards(spark, folder, write_shards(read_table(spark, sf_dir, "documents"), folder))
