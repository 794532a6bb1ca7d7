"""Token ids of documents in compressed binary files.

Texts are tokenized with the tokenizers library. The vocabulary's pre-tokens
never cross ASCII white space, nor the place between letters and the marks after
them, so the ids of a text are those of its words' parts, put together: a worker
tokenizes each distinct part once and keeps a bounded number of them, and array
operations put the ids in place. Ids of all documents, in ascending doc_id order and each
ended by END_ID, are cut into blocks of BLOCK ids per file; a block is coded by
the range coder of codec.py, as rows of ROW ids, with a model of its own, and carries
the checksum of its ids as 16-bit numbers, the documents that end in it and the number of documents before it in
its file. The container is a Spark table, so files are written and read through the cluster's store.

Defined cases: a null or empty text is the end id alone; a null doc_id comes
first; repeated doc_ids are separate documents in the order of their ids; an
empty table gives files without blocks; extra columns are ignored. A block whose
checksum does not match stops the read with an error.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm import codec
from textquarry.llm.common import scratch_path, staged

END_ID = 2
#: Rows of a block, and ids of a row.
LANES, ROW = 4096, 1024
BLOCK = LANES * ROW
FILE_IDS = 16_000_000
#: Text that is tokenized at a time, in bytes, and one document at least.
PIECE_BYTES = 8 << 20
#: Parts whose ids a worker keeps; beyond, it begins anew.
KNOWN_PARTS = 2_000_000
#: Places for their numbers, as a power of two, in each of two tables; bytes of parts that are hashed at a time.
TABLE_BITS, HASHED_BYTES = 22, 1 << 18
_BASE = 0x5851F42D4C957F2D
#: Powers of an odd number and of its inverse.
_POWERS = np.multiply.accumulate(np.stack([np.concatenate([np.ones(1, np.uint64), np.full(HASHED_BYTES, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]), axis=1)
#: Parts that go to the library in one text; with 2000 it took 1.3 to 1.9 times as long.
ROW_PARTS = 100
#: ASCII marks but the apostrophe, which begins contractions; \\x00 and other controls are no marks here.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters whose lower case and normal form are single, the same in every library: ASCII, Latin-1 and most of Latin Extended-A.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0137\u0139-\u0148\u014a-\u017e]+$"
FORMAT = "shard int, block long, n_ids int, crc32 long, first_doc long, doc_ids array<long>, doc_ends array<int>, payload binary"


class Words:
    """Ids of white-space-free parts of text, by a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids above 65535 do not fit the file format")
        # parts of plain letters in lower case need no normalization and are one pre-token each
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(self.whole.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(1 << 16, bool)
        if suffix:
            self.ends[[i for word, i in self.whole.get_vocab().items() if word.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """What is known of parts: their names, where their ids begin in the store, and how many they are; by hash, their numbers."""
        self.names, self.begin, self.sizes, self.store = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2")
        self.table = np.full((2, 1 << TABLE_BITS), -1, np.int32)

    def known(self, parts: pa.Array, slots: np.ndarray) -> np.ndarray:
        """The numbers of parts, -1 for those that are in neither of their places in the table."""
        found = np.full(len(parts), -1, np.int64)
        for table, slot in zip(self.table, slots, strict=True):
            here = table.take(slot)
            some = np.flatnonzero((here >= 0) & (found < 0))
            if len(some):
                same = pc.equal(self.names.take(pa.array(here[some])), parts.take(pa.array(some))).to_numpy(zero_copy_only=False)
                found[some[same]] = here[some[same]]
        return found

    def _enter(self, numbers: np.ndarray, slots: np.ndarray) -> None:
        """Puts parts where the table has room for them; without room, one gives way and is looked up anew when it comes again."""
        free = np.flatnonzero(self.table[0].take(slots[0]) < 0)
        self.table[0][slots[0][free]] = numbers[free]
        out = np.flatnonzero(self.table[0].take(slots[0]) != numbers)
        self.table[1][slots[1][out]] = numbers[out]

    def places(self, parts: pa.Array) -> np.ndarray:
        """The numbers of distinct parts among those known; the ids of new ones are looked up."""
        if len(self.names) > KNOWN_PARTS:
            self._forget()
        slots = _slots(parts)
        out = self.known(parts, slots)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        fresh = parts.take(pa.array(new))
        easy = pc.and_(pc.match_substring_regex(fresh, PLAIN), pc.equal(fresh, pc.utf8_lower(fresh)))
        plain, other = fresh.filter(easy), fresh.filter(pc.invert(easy))
        known, held = len(self.names), len(self.store)
        (ids_a, n_a), (ids_b, n_b) = self.plain_ids(plain), self.other_ids(other)
        sizes = np.concatenate([n_a, n_b])
        self.names = pa.concat_arrays([self.names, plain, other])
        self.store = np.concatenate([self.store, ids_a, ids_b])
        self.begin = np.concatenate([self.begin, held + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        flags = easy.to_numpy(zero_copy_only=False)
        numbers = np.empty(len(fresh), np.int64)
        numbers[flags], numbers[~flags] = known + np.arange(len(plain)), known + len(plain) + np.arange(len(other))
        self._enter(numbers, slots[:, new])
        out[new] = numbers
        return out

    def plain_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts of plain letters, and how many each part has."""
        if not len(parts):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        names = parts.to_pylist()
        rows = [" ".join(names[i : i + ROW_PARTS]) for i in range(0, len(names), ROW_PARTS)]
        got = self.plain.encode_batch_fast(rows, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u2") for e in got])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(parts) or last[-1] != len(ids) - 1:
            return self.other_ids(parts)
        return ids, np.diff(last, prepend=-1)

    def other_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of any kind."""
        got = [e.ids for e in self.whole.encode_batch_fast(parts.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], "<u2"), np.array([len(ids) for ids in got], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.values.dictionary_encode()
        words = coded.dictionary
        # a word of plain letters and the marks after it are two parts, any other word is one
        core = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(core, PLAIN)
        core = pc.if_else(plain, pc.utf8_lower(core), words)
        tail_at = pc.binary_length(pc.if_else(plain, pc.utf8_rtrim(words, MARKS), words)).to_numpy()
        tails, starts = words.cast(pa.binary()), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        tail_sizes = np.diff(starts) - tail_at
        tail_bytes = _sliced(tails, starts[:-1] + tail_at, tail_sizes)
        every = pa.concat_arrays([core, tail_bytes.cast(pa.string())]).dictionary_encode()
        of = self.places(every.dictionary)[every.indices.to_numpy().reshape(2, -1).T.ravel()]
        # the ids of each distinct word, then of each word in its place
        sizes = self.sizes[of]
        word_ids = self.store[_ranges(self.begin[of], sizes)]
        word_sizes = sizes.reshape(-1, 2).sum(axis=1)
        # every word's ids as bytes, END_ID as one more, put one after the other in the order of the texts
        offsets = np.concatenate([[0], np.cumsum(word_sizes * 2), [2 * len(word_ids) + 2]]).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(word_sizes) + 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(word_ids.tobytes() + np.array([END_ID], "<u2").tobytes())])
        bounds = np.frombuffer(split.buffers()[1], np.int32)[split.offset : split.offset + len(split) + 1]
        used = np.insert(coded.indices.to_numpy(), bounds[1:] - bounds[0], len(word_sizes))
        taken = held.take(pa.array(used))
        places = np.frombuffer(taken.buffers()[1], np.int32)
        ends = places[bounds[1:] - bounds[0] + np.arange(1, len(texts) + 1)]
        return np.frombuffer(taken.buffers()[2], "<u2")[: places[len(used)] // 2], np.diff(ends, prepend=0).astype(np.int64) // 2


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), then those of begin[1], and so on."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(size.sum())


def _sliced(values: pa.Array, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte strings that begin and end at these places of the array's data."""
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[_ranges(begin.astype(np.int64), size.astype(np.int64))].tobytes())])


def _slots(parts: pa.Array) -> np.ndarray:
    """Two places in a table for each string, from a polynomial of its bytes."""
    bounds = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
    out = np.zeros(len(parts), np.uint64)
    a = 0
    while a < len(parts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + HASHED_BYTES, side="right")) - 1)
        body = data[bounds[a] : bounds[b]]
        if len(body) > HASHED_BYTES:  # one long string
            out[a] = zlib.crc32(body) * 0x9E3779B97F4A7C15 % (1 << 64)
        else:
            sums = np.zeros(len(body) + 1, np.uint64)
            np.cumsum((body + np.uint64(1)) * _POWERS[0, : len(body)], out=sums[1:])
            at = bounds[a : b + 1] - bounds[a]
            out[a:b] = (sums[at[1:]] - sums[at[:-1]]) * _POWERS[1].take(at[:-1], mode="clip")
        a = b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return np.stack([out & mask, out >> np.uint64(TABLE_BITS) & mask]).astype(np.int64)


_words: dict[str, Words] = {}


def _piece_bounds(texts: pa.Array) -> list[int]:
    """Where to cut texts so that a piece has PIECE_BYTES, or one document."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0]
    while cuts[-1] < len(texts):
        before = sizes[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, side="right"))))
    return cuts


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = Words(path)
        for batch in batches:
            cuts = _piece_bounds(batch.column("text"))
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a)
                ids, sizes = _words[path].encode(piece.column("text"))
                offsets = np.concatenate([[0], np.cumsum(sizes * 2)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes, pa.int64()), raw], names=["doc_id", "n_tokens", "ids"])

    return run


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens (with the end id) and ids (16-bit little-endian)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_tokenized(path), "doc_id long, n_tokens long, ids binary")


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _row_ids(n: int) -> int:
    """Ids of a row in a block of n ids: fewer in a small block, so that it has many rows too."""
    return min(ROW, max(64, -(-n // LANES)))


def _rows(ids: np.ndarray) -> np.ndarray:
    """A block's ids as rows, the last one filled up with zeros."""
    width = _row_ids(len(ids))
    return np.concatenate([ids, np.zeros(-len(ids) % width, np.uint16)]).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    held: list[bytes] = []
    docs: list[int | None] = []
    ends: list[int] = []
    size = written = first_doc = 0

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal size, written, first_doc, held, docs, ends
        ids = np.frombuffer(b"".join(held), "<u2")
        n = -(-size // BLOCK) if last else size // BLOCK
        took = min(size, n * BLOCK)
        cuts = [ids[b * BLOCK : min(took, (b + 1) * BLOCK)] for b in range(n)]
        stops = np.searchsorted(np.array(ends, np.int64), (np.arange(n) + 1) * BLOCK, side="right")
        starts = np.concatenate([[0], stops[:-1]])
        columns = [
            pa.array([shard] * n, pa.int32()), pa.array(range(written, written + n), pa.int64()), pa.array([len(c) for c in cuts], pa.int32()),
            pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array([first_doc + int(s) for s in starts], pa.int64()),
            pa.array([docs[a:b] for a, b in zip(starts, stops, strict=True)], pa.list_(pa.int64())),
            pa.array([[e - k * BLOCK for e in ends[a:b]] for k, (a, b) in enumerate(zip(starts, stops, strict=True))], pa.list_(pa.int32())),
            pa.array([codec.encode(_rows(c)) for c in cuts], pa.binary()),
        ]
        done = int(stops[-1])
        held, docs, ends = [ids[took:].tobytes()], docs[done:], [e - took for e in ends[done:]]
        size, written, first_doc = size - took, written + n, first_doc + done
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FORMAT.split(", ")])

    for batch in batches:
        for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
            raw = ids.as_py()
            held.append(raw)
            size += len(raw) // 2
            docs.append(doc)
            ends.append(size)
            if size >= BLOCK:
                yield flush(False)
    if size:
        yield flush(True)


def write(docs: DataFrame, tokenizer: str, out: str, file_ids: int = FILE_IDS) -> None:
    """Writes the files of all documents to the folder `out`."""
    tokens = staged(tokenize(docs, tokenizer), "tokens")
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    files = max(1, -(-total // file_ids))
    # one file per range of doc_id; ids of one document stay in one file
    placed = tokens.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    placed.select("doc_id", "ids").mapInArrow(_blocks, FORMAT).write.option("parquet.page.size.row.check.min", 1).parquet(out)  # rows are of some MB: look at the room after each


def decoded(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of a batch's blocks, checked."""
    out = []
    for i, (n, payload, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_ids", "payload", "crc32")), strict=True)):
        out.append(codec.decode(payload, _row_ids(n)).ravel()[:n])
        if zlib.crc32(out[-1]) != total:
            raise ValueError(f"block {batch.column('block')[i]} of shard {batch.column('shard')[i]} is damaged")
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part of a document in a block."""
    for batch in batches:
        rows = []
        for i, ids in enumerate(decoded(batch)):
            shard, block, first = (batch.column(c)[i].as_py() for c in ("shard", "block", "first_doc"))
            ends, docs = batch.column("doc_ends")[i].as_py(), batch.column("doc_ids")[i].as_py()
            at = 0
            for k, end in enumerate([*ends, len(ids)]):
                if end > at:
                    rows.append((shard, first + k, docs[k] if k < len(docs) else None, block * BLOCK + at, end - at, _checksum(ids[at:end])))
                at = end
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "doc_no", "doc_id", "at", "n", "crc32"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each document from those of its pieces."""
    for batch in batches:
        sums = []
        for pieces in batch.column("pieces").to_pylist():
            total = pieces[0]["crc32"]
            for p in pieces[1:]:
                blank = bytes(4 * p["n"])
                total = zlib.crc32(blank, total) ^ zlib.crc32(blank) ^ p["crc32"]
            sums.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("head"))  # one row per file
    pieces = blocks.mapInArrow(_pieces, "shard int, doc_no long, doc_id long, at long, n long, crc32 long")
    whole = pieces.groupBy("shard", "doc_no").agg(F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "n", "crc32"))).alias("pieces"))
    placed = whole.join(heads, "shard").select("doc_id", (F.col("head") + F.col("at")).alias("start"), "n_tokens", "pieces")
    return placed.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files to the shared folder and describes the documents read back from them."""
    spark = docs.sparkSession
    out = scratch_path(spark, "token-files")
    write(docs, tokenizer, out)
    return digests(spark, out)
