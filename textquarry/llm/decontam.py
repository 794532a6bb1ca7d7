"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents that one Arrow batch holds. Its words, as
numbers of the benchmark's vocabulary, become one sequence; pairs of neighbours
that no benchmark window contains cannot lie inside an occurrence and are cut
out first. Over the sequence stands an FM-index: the Burrows-Wheeler transform
in a wavelet matrix. All windows are searched backwards at once, and their
occurrences located from sampled suffix positions. Overlapping hits merge into
removal spans.

Benchmark texts are sent out in blocks of at most BLOCK_BYTES; with more than
one block, spans of all blocks are merged per document.

Defined cases: a null or wordless text has no words and no hits; an item of
fewer words than a window is one window of its own, an item without words
none; repeated items count by item_id, items without an id as one that is not
listed by name; repeated documents get equal results;
empty tables give empty results or no hits; extra columns pass through if kept
(names that begin with two underscores are its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import staged

WINDOW = 10
BLOCK_BYTES = 16 << 20
SAMPLE_EVERY = 8
#: Lower case for A-Z, a blank for everything that is no word character; bytes from 0x80 on stay.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
SEPARATOR = 1  # 0 ends the sequence; words begin at 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; seq ends with its only 0."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank = fresh
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Counts and places of patterns in a sequence of small numbers that ends with its only 0."""

    def __init__(self, seq: np.ndarray, every: int = SAMPLE_EVERY):
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1].astype(np.int64)
        self.top = int(seq.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=self.top + 1))]).astype(np.int64)
        self.levels = max(1, self.top.bit_length())
        self.ones, self.zeros = [], []
        row = self.bwt
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        # where each symbol's run begins on the last level
        self.base = self._descend(np.arange(self.top + 1), np.zeros(self.top + 1, np.int64))
        self.marked = sa % every == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = sa[self.marked]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.levels))):
            up = self.ones[i][at]
            at = np.where((symbol >> level) & 1, self.zeros[i] + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first `at` entries of the transform."""
        return self._descend(symbol, at) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns of equal length (rows): the ranges of suffixes that begin with them."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero((patterns <= self.top).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for column in reversed(range(patterns.shape[1])):
            c = patterns[live, column]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows of the suffix array."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.marked[at]
            out[open_[hit]] = self.samples[self.mark_rank[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            c = self.bwt[at]
            rows[open_] = self.before[c] + self.rank(c, at)
            steps += 1
        return out


def _distinct(rows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows, the places in the last array where each one's owners begin and end, and these owners."""
    key = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], (rows[order[1:]] != rows[order[:-1]]).any(axis=1)])
    if (new[1:] & (key[order[1:]] == key[order[:-1]])).any():  # two rows of one key may alternate
        order = np.lexsort(rows.T)
        new = np.concatenate([[True], (rows[order[1:]] != rows[order[:-1]]).any(axis=1)])
    return rows[order[new]], np.append(np.flatnonzero(new), len(rows)), owners[order]


class Windows:
    """The benchmark's distinct windows as numbers, with the items that hold them; some 60 bytes for each word of an item."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids = [item for item, _ in items]
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            coded = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words), np.int32, len(words))
            if k := min(window, len(coded)):
                by_length.setdefault(k, []).append((np.lib.stride_tricks.sliding_window_view(coded, k), number))
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, found in sorted(by_length.items()):
            self.groups.append(_distinct(np.concatenate([rows for rows, _ in found]), np.repeat([n for _, n in found], [len(rows) for rows, _ in found])))
        self.span = len(self.vocabulary) + 2
        pairs = [(g[:, :-1].astype(np.int64) * self.span + g[:, 1:]).ravel() for g, _, _ in self.groups if g.shape[1] > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.singles = np.concatenate([g.ravel() for g, _, _ in self.groups if g.shape[1] == 1] or [np.zeros(0, np.int32)])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.pairs % (1 << 20)] = True


def _kept_words(coded: np.ndarray, windows: Windows) -> np.ndarray:
    """Which words may lie in an occurrence: those of a pair, or alone, that some window holds."""
    keep = np.isin(coded, windows.singles) if len(windows.singles) else np.zeros(len(coded), bool)
    if len(windows.pairs) and len(coded) > 1:
        key = coded[:-1] * windows.span + coded[1:]
        maybe = np.flatnonzero(windows.filter[key % (1 << 20)] & (coded[:-1] > 1) & (coded[1:] > 1))
        at = np.minimum(np.searchsorted(windows.pairs, key[maybe]), len(windows.pairs) - 1)
        sure = maybe[windows.pairs[at] == key[maybe]]
        keep[sure] = True
        keep[sure + 1] = True
    return keep


def search_shard(texts: list[str | None], windows: Windows) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each text: words, starts and ends of merged removal spans (in words), items."""
    get = windows.vocabulary.get
    parts, sizes = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        parts.append(np.fromiter((get(w, SEPARATOR) for w in words), np.int64, len(words)))
        parts.append(np.array([SEPARATOR], np.int64))
    out: list[tuple[int, list[int], list[int], list[int]]] = [(n, [], [], []) for n in sizes]
    if not texts or not windows.groups:
        return out
    coded = np.concatenate(parts)
    first = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    where = np.flatnonzero(_kept_words(coded, windows))
    if not len(where):
        return out
    # a separator wherever the kept words are not neighbours in the shard
    gap = np.diff(where, prepend=where[0]) > 1
    place = np.arange(len(where)) + np.cumsum(gap)
    seq = np.full(place[-1] + 3, SEPARATOR, np.int64)
    seq[place] = coded[where]
    seq[-1] = 0
    origin = np.full(len(seq), -1, np.int64)
    origin[place] = where
    index = FMIndex(seq)
    hit_at, hit_len, hit_items = [], [], []
    for rows, bounds, owners in windows.groups:
        low, high = index.search(rows)
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        times = high[some] - low[some]
        owner = np.repeat(some, times)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hit_at.append(origin[index.locate(low[owner] + inner)])
        hit_len.append(np.full(len(owner), rows.shape[1], np.int64))
        hit_items.extend(owners[bounds[w] : bounds[w + 1]] for w in owner)
    if not hit_at:
        return out
    at, length = np.concatenate(hit_at), np.concatenate(hit_len)
    doc = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, doc))
    bounds = np.flatnonzero(np.diff(doc[order], prepend=-1))
    for group in np.split(order, bounds[1:]):
        d = int(doc[group[0]])
        starts, ends = merged(at[group] - first[d], at[group] - first[d] + length[group])
        items = {windows.item_ids[i] for i in np.unique(np.concatenate([hit_items[g] for g in group]))}
        out[d] = (sizes[d], starts, ends, sorted(items, key=lambda i: (i is None, i)))
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of half-open spans, sorted by start."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)
    return starts[new].tolist(), ends[last].tolist()


FOUND = T.StructType([
    T.StructField("__n_words", T.LongType()),
    T.StructField("__starts", T.ArrayType(T.LongType())),
    T.StructField("__ends", T.ArrayType(T.LongType())),
    T.StructField("__items", T.ArrayType(T.LongType())),
])


def _probe(docs: DataFrame, items: list[tuple[int, str | None]], keep: list[str]) -> DataFrame:
    windows = docs.sparkSession.sparkContext.broadcast(Windows(items))  # at most BLOCK_BYTES of text

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = search_shard(batch.column("__text").to_pylist(), windows.value)
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            kept = batch.remove_column(batch.schema.get_field_index("__text"))
            arrays = [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*kept.schema.names, *FOUND.names])

    schema = T.StructType([docs.schema[c] for c in keep] + FOUND.fields)
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(batches, schema)


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, __n_words, __starts and __ends of the removal spans (in words), and __items."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks == 1:
        return _probe(docs, [tuple(r) for r in items.collect()], keep)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks * 2))
    # the blocks meet by this key alone, so that repeated rows stay apart
    base = staged(docs.select(*keep, F.col("text").cast("string").alias("__text"), F.monotonically_increasing_id().alias("__row")), "rows")
    found = None
    for b in range(blocks * 2):
        one = _probe(base.select("__row", F.col("__text").alias("text")), [tuple(r) for r in items.filter(part == b).collect()], ["__row"])
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("__row").agg(F.max("__n_words").alias("__n_words"), F.flatten(F.collect_list("__starts")).alias("__from"), F.flatten(F.collect_list("__ends")).alias("__to"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
    rows = base.drop("__text").join(found, "__row")

    def joined(rows_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in:
            both = [merged(np.array(s), np.array(e)) if s else ([], []) for s, e in zip(batch.column("__from").to_pylist(), batch.column("__to").to_pylist(), strict=True)]
            arrays = [batch.column("__n_words"), pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.list_(pa.int64())), batch.column("__items")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=[*keep, *FOUND.names])

    return rows.mapInArrow(joined, T.StructType([docs.schema[c] for c in keep] + FOUND.fields))


def hit_words():
    """Words inside the removal spans, as a column of what find returns."""
    return F.aggregate(F.zip_with("__starts", "__ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def items_digest():
    """SHA-256 of the items, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ","), 256)

