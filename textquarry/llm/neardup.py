"""MinHash near-duplicates by a chosen-path similarity join.

Documents of equal shingle sets form one class. Every class walks down TREES
independent trees: each of the first DEPTH steps selects one minwise token, and
the tokens chosen so far name the node. Two classes of similarity s share a
tree's node with chance s ** DEPTH, so at 0.8 the trees together miss a pair
with chance 3e-5, at 0.85 with 4e-7.

Small nodes are compared exhaustively. In a larger node all members are first
compared with one pivot. Members of one component need no further comparison
among themselves, so a node of near copies is finished then. A node that still
holds several components is compared exhaustively on full sets, if its sets
have at most FULL shingles together and at most WORK comparisons are left. If
it is larger and only few members stand outside its largest component, they are
compared with all; else the node branches again, along BRANCHES paths of STEPS
more selected tokens each, and so on. In nodes that are still mixed after LEVELS
levels, two members meet if they share a token among the rarest of each that
two linked sets cannot miss (a prefix join, which is exact). Single pairs
pass a sketch filter 4.5 standard errors wide (it stops one linked pair in
300,000), and are confirmed on their full sets of 64-bit hashes. Rows of a node
that holds very many members are never dealt out by node.

Defined cases: A-Z count as a-z; a text of fewer words than a shingle is one
shingle; a null or blank text has none and links with nothing; repeated rows
are one class; where one doc_id stands for several texts, links of any of them
count for it (keep_one numbers rows by itself and keeps them apart); a null
doc_id stays alone, with a null component; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import key_joined, maybe_among, semi_joined, staged

DEPTH = 4
TREES = 20
COORDS = DEPTH * TREES
SMALL = 32
PIVOTS = 16
FULL = 1 << 20
WORK = 40_000_000
SALTS = 64
#: Word hashes that a worker keeps.
KNOWN_WORDS = 200_000
BRANCHES = 4
STEPS = 3
LEVELS = 5
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FOLD_A, _FOLD_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_draw = np.random.default_rng(20240229)
_MUL = _draw.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_word_hashes: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FOLD_A
    x = (x ^ (x >> np.uint64(27))) * _FOLD_B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = text.encode().translate(LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if len(_word_hashes) > KNOWN_WORDS:
        _word_hashes.clear()
    known = _word_hashes
    hashes = np.empty(n, np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        hashes[i] = h
    width = min(size, n)
    state = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        state = _mixed(state * _SPREAD + hashes[j : n - width + 1 + j])
    return np.unique(state)


def minwise(values: np.ndarray) -> np.ndarray:
    """COORDS minwise tokens of a set, as 32-bit numbers."""
    out = np.empty(COORDS, np.uint32)
    step = max(1, (1 << 18) // max(1, len(values)))
    for i in range(0, COORDS, step):
        mixed = (np.multiply.outer(_MUL[i : i + step], values) + _ADD[i : i + step, None]) >> np.uint64(32)
        out[i : i + step] = mixed.min(axis=1)
    return out


def _feature_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                piece = batch.slice(part, 2000)
                n, keys, sketches, coords = [], [], [], []
                for text in piece.column("text"):
                    values = shingle_set(text.as_py(), size)
                    tokens = minwise(values) if len(values) else np.zeros(COORDS, np.uint32)
                    n.append(len(values))
                    keys.append(xxhash.xxh128_digest(values.tobytes()))
                    sketches.append(tokens.astype(np.uint8).tobytes())
                    coords.append(tokens.view(np.int32))
                flat = pa.array(np.concatenate(coords)) if coords else pa.array([], pa.int32())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COORDS), flat)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), rows], names=["doc_id", "n_shingles", "set_key", "sketch", "coords"])

    return run


def features(docs: DataFrame, size: int) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_feature_batches(size), "doc_id long, n_shingles long, set_key binary, sketch binary, coords array<int>")


def _pairs_within(nodes: DataFrame) -> DataFrame:
    """All pairs of differing labels in nodes of at most SMALL members."""
    gathered = nodes.groupBy("node").agg(F.collect_list(F.struct("rep", "label")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda y: (y["label"] != x["label"]) & (y["rep"] != x["rep"])), lambda y: F.struct(F.least(x["rep"], y["rep"]).alias("a"), F.greatest(x["rep"], y["rep"]).alias("b")))))
    return gathered.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _pairs_with_pivot(nodes: DataFrame) -> DataFrame:
    pivots = nodes.groupBy("node").agg(F.min_by("rep", F.struct(F.xxhash64("node", "rep"), "rep")).alias("pivot"), F.count("*").alias("n"))
    both = key_joined(nodes, pivots, "node", nodes.count())
    return both.filter("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))


def _sized(nodes: DataFrame, total: int) -> DataFrame:
    counts = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    return key_joined(nodes, counts.withColumn("members", F.col("n")), "node", total)


def _likely(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches do not rule it out."""
    s = num / den
    least = max(0, math.floor(COORDS * s - 4.5 * math.sqrt(COORDS * s * (1 - s))))
    side = reps.select("rep", "n_shingles", "sketch")
    both = pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
    both = both.filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDS) for c in ("sketch_a", "sketch_b"))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids (rep); texts of most others are left out before anything is shuffled."""
    some = maybe_among(docs.select("doc_id", "text").filter("doc_id is not null"), F.col("doc_id"), ids.select("rep"), "__maybe").filter("__maybe")
    return some.select("doc_id", "text").join(ids.hint("shuffle_merge"), F.col("doc_id") == ids["rep"], "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return _only(docs, ids).mapInArrow(run, "rep long, shingles binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = staged(_sets(docs, ids, size), "sets")
    # the same plan at every size: neither side is ever broadcast
    both = pairs.join(sets.toDF("a", "x").hint("shuffle_merge"), "a").join(sets.toDF("b", "y").hint("shuffle_merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both_ = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both_ >= num * (len(p) + len(q) - both_))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """rep and label, the smallest id reachable over links (a, b), by label passing and pointer jumping."""
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = edges.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(seen, labels["rep"] == seen["a"]).select("rep", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        lower = staged(lower, "lower")
        jump = lower.select(F.col("rep").alias("at"), F.col("label").alias("next"))
        labels = staged(lower.join(jump, lower["label"] == jump["at"], "left").select("rep", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "labels")
        changed = labels.filter("label <> was").limit(1).count()
        labels = labels.select("rep", "label")
        if not changed:
            return labels


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes (node, rep) with labels, without the nodes of one label."""
    known = staged(nodes.join(labels, "rep", "left").select("node", "rep", F.coalesce("label", "rep").alias("label")), "labelled")
    mixed = known.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("node", "n")
    return key_joined(known, mixed, "node", known.count())


def _compared(nodes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components of each node (node, rep, label), found on full sets.

    One member after another is compared with all others, those of small
    components first. When those that are left are of one component, every two
    members of different components have met.
    """
    # trees often lead the same members together: one node of each such set is enough
    same = nodes.groupBy("node").agg(F.sum(F.xxhash64("rep") % (1 << 40)).alias("h"), F.count("*").alias("n")).groupBy("h", "n").agg(F.min("node").alias("node"))
    nodes = staged(semi_joined(nodes, same, "node", nodes.count()), "compared")
    sets = staged(_sets(docs, nodes.select("rep").distinct(), size), "sets")

    def run(table: pa.Table) -> pa.Table:
        reps, labels = table.column("rep").to_numpy(), table.column("label").to_numpy().copy()
        members = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(m) for m in members])
        values, owners = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        todo, links = np.ones(len(reps), bool), []
        while len((left := np.unique(labels[todo], return_counts=True))[0]) > 1:
            pick = np.flatnonzero(todo & (labels == left[0][left[1].argmin()]))[0]
            todo[pick] = False
            low, high = np.searchsorted(values, members[pick], "left"), np.searchsorted(values, members[pick], "right")
            lengths = high - low
            at = np.arange(lengths.sum()) + np.repeat(low - np.cumsum(lengths) + lengths, lengths)
            both = np.bincount(owners[at], minlength=len(reps))
            linked = np.flatnonzero((den * both >= num * (sizes + sizes[pick] - both)) & (labels != labels[pick]))
            for other in linked:
                if labels[other] != labels[pick]:
                    links.append((min(reps[pick], reps[other]), max(reps[pick], reps[other])))
                    labels[labels == labels[other]] = labels[pick]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return nodes.join(sets.hint("shuffle_merge"), "rep").groupBy("node").applyInArrow(run, "a long, b long")


def _prefix_pairs(nodes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of a node (node, rep, label) with different labels, no linked pair left out.

    Two sets of n and m tokens with den * common >= num * union share, in any one
    order of tokens, one of the first n - ceil(n * num / den) + 1 of the one and
    of the first so many of the other. Rare tokens of the node come first, so few
    members meet at one token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                tokens = shingle_set(text.as_py(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), rep.as_py(), np.int64)), pa.array(np.full(len(tokens), len(tokens), np.int64)), pa.array(tokens)], names=["rep", "n", "token"])

    tokens = staged(_only(docs, nodes.select("rep").distinct()).mapInArrow(run, "rep long, n long, token long"), "tokens")
    rows = staged(nodes.join(tokens, "rep").select("node", "rep", "label", F.col("n").alias("size"), "token"), "held")
    uses = rows.groupBy("node", "token").agg(F.count("*").alias("uses"))
    ranked = rows.join(uses, ["node", "token"]).withColumn("place", F.row_number().over(Window.partitionBy("node", "rep").orderBy("uses", "token")))
    prefix = staged(ranked.filter((F.col("place") <= F.col("size") - F.ceil(F.col("size") * num / den) + 1) & (F.col("uses") > 1)).select("node", "token", "rep", "label", "size"), "prefix")
    other = prefix.toDF("node", "token", "rep_b", "label_b", "size_b")
    both = prefix.join(other, ["node", "token"]).filter((F.col("rep") < F.col("rep_b")) & (F.col("label") != F.col("label_b")) & (F.least("size", "size_b") * den >= F.greatest("size", "size_b") * num))
    return both.select(F.col("rep").alias("a"), F.col("rep_b").alias("b"))


def _deeper(nodes: DataFrame, reps: DataFrame, labels: DataFrame, level: int, docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Pairs to test, nodes to go on with and nodes to compare in full, of nodes that one pivot has not finished."""
    mixed = staged(_labelled(nodes, labels), "mixed")
    if mixed.isEmpty():
        return mixed.select(F.col("rep").alias("a"), F.col("rep").alias("b")), None, mixed
    total = mixed.count()
    weight = mixed.join(reps.select("rep", "n_shingles"), "rep").groupBy("node").agg(F.sum("n_shingles").alias("weight"))
    by_label = mixed.groupBy("node", "label").agg(F.count("*").alias("n"))
    top = by_label.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("n"))
    rest = F.col("n") - F.col("most")
    top = staged(top.join(weight, "node"), "tops")
    easy = (F.col("weight") <= FULL) & (rest * F.col("n") <= WORK)
    full = key_joined(mixed, top.filter(easy).select("node", "n"), "node", total)
    top = top.filter(~easy)
    if top.isEmpty():
        return mixed.limit(0).select(F.col("rep").alias("a"), F.col("rep").alias("b")), None, full
    heavy = staged(key_joined(mixed, top.select("node", "n"), "node", total), "heavy")
    finish, top = top.filter(rest <= PIVOTS), top.filter(rest > PIVOTS)
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt")
    outside = key_joined(heavy, finish.select("node", "top", "n"), "node", total).filter("label <> top")
    outside = outside.select("node", F.col("rep").alias("x"), F.col("label").alias("x_label"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = heavy.select("*", salt).join(outside, ["node", "salt"]).filter("label <> x_label").select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b"))
    go = key_joined(heavy, top.select("node", "n"), "node", total)
    if level >= LEVELS:
        return pairs.unionByName(_prefix_pairs(go, docs, size, num, den)), go.select("node", "rep").limit(0), full
    tokens = [F.element_at("coords", F.pmod(F.xxhash64("node", "path", F.lit(k)), F.lit(COORDS)).cast("int") + 1) for k in range(STEPS)]
    child = go.join(reps.select("rep", "coords"), "rep").withColumn("path", F.explode(F.array(*[F.lit(p) for p in range(BRANCHES)]))).select("rep", "label", F.xxhash64("node", "path", *tokens).alias("node"))
    child = staged(child.distinct(), "grown")
    child = staged(_sized(child, child.count()), "children")
    pairs = pairs.unionByName(_pairs_within(child.filter(F.col("members") <= SMALL)))
    large = child.filter(F.col("members") > SMALL).select("node", "rep")
    return pairs.unionByName(_pairs_with_pivot(large)), large, full


def classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id; linked are texts with den * intersection >= num * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = staged(features(docs, size), "features")
    reps = feats.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("coords").alias("coords"))
    reps = staged(reps, "reps")
    feats = feats.select("doc_id", "n_shingles", "set_key")
    # two different sets can only be linked if they share this many shingles
    usable = reps.filter(F.col("n_shingles") >= -(-num // max(1, den - num)))
    path = [F.xxhash64(F.lit(t), *[F.element_at("coords", t * DEPTH + k + 1) for k in range(DEPTH)]) for t in range(TREES)]
    nodes = usable.select("rep", F.explode(F.array(*path)).alias("node"))
    nodes = staged(_sized(nodes, usable.count() * TREES), "nodes")
    lone = nodes.withColumn("label", F.col("rep"))
    large = nodes.filter(F.col("members") > SMALL).select("node", "rep")
    pairs = _pairs_within(lone.filter(F.col("members") <= SMALL)).unionByName(_pairs_with_pivot(large))
    tested = links = None
    for level in range(LEVELS + 1):
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(_likely(pairs, reps, num, den), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = staged(_confirmed(pairs, docs, size, num, den), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        if level == LEVELS:
            break
        pairs, large, full = _deeper(large, reps, labels, level + 1, docs, size, num, den)
        if not full.isEmpty():
            links = links.unionByName(staged(_compared(full, docs, size, num, den), "links"))
            labels = components(links)
        if large is None:
            break
    known = reps.join(labels, "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component"))
    out = feats.join(known, "set_key", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without all but the first document of each component; rows with a null doc_id stay.

    Every row counts by itself, whatever ids repeat. Blank texts link with
    nothing: of those only repeats of one doc_id are left out.
    """
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    named = rows.filter("doc_id is not null")
    found = classes(named.select(F.col("__row").alias("doc_id"), "text"), size, num, den)
    ids = named.select("__row", F.col("doc_id").cast("long").alias("__id"))
    blank = F.col("n_shingles") == 0
    group = F.struct(blank.alias("blank"), F.when(blank, F.col("__id")).otherwise(F.col("component_id")).alias("of"))
    first = found.join(ids, found["doc_id"] == ids["__row"]).groupBy(group.alias("g")).agg(F.min(F.struct("__id", "__row"))["__row"].alias("__row"))
    return named.join(first, "__row", "left_semi").unionByName(rows.filter("doc_id is null")).select(*docs.columns)
