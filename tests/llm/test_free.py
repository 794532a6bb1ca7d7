"""Language, near-duplicates, lines, decontamination, token files and quality rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import frame, sentence
from textquarry.llm import codec, decontam, language, lines, neardup, quality, token_files


def _shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(*[words[i:] for i in range(size)], strict=False)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def _components(rows, size, num, den):
    sets = [(i, _shingles(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both) and top(i) != top(j):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in parent}


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, odd_docs, odd, size, num, no_docs, monkeypatch):
    wanted = _components([(i, t) for i, t, _, _ in odd], size, num, 100)
    rows = neardup.classes(odd_docs, size, num, 100).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert r["component_id"] == (None if r["doc_id"] is None else wanted[r["doc_id"]])
    by_id = {i: len(_shingles(t, size)) for i, t, _, _ in odd}
    assert all(r["n_shingles"] == by_id[r["doc_id"]] for r in rows)
    if size == 5:
        assert neardup.classes(no_docs, size, num, 100).count() == 0
        kept = neardup.keep_one(odd_docs, size, num, 100)
        assert kept.columns == odd_docs.columns
        assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(wanted.values()))


@pytest.mark.parametrize("full", [0, 600, 1 << 20])
def test_large_nodes_branch(spark, monkeypatch, full):
    """Hundreds of texts near each other, of which only some are linked."""
    monkeypatch.setattr(neardup, "SMALL", 6)
    monkeypatch.setattr(neardup, "PIVOTS", 3)
    monkeypatch.setattr(neardup, "FULL", full)
    draw = random.Random(3)
    base = sentence(draw, 60).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.choice([0, 1, 2, 4])):
            words[draw.randrange(60)] = f"edit{draw.randrange(40)}"
        rows.append((i, " ".join(words), "en", "a"))
    wanted = _components([(i, t) for i, t, _, _ in rows], 3, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(frame(spark, rows), 3, 85, 100).collect()}
    assert got == wanted


def test_boilerplate_lines(spark, no_docs):
    rows = [(i, f"own line {i}\n  Shared licence.  \n\nlast {i % 3}", "en", f"s{i % 6}") for i in range(30)]
    rows += [(100, None, "en", "s1"), (101, "", "en", "s1"), (102, "only here\nonly here", "en", "s1"), (103, "Shared licence.", "en", None)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in lines.remove_boilerplate(docs, min_sites=4).collect()}
    sites = defaultdict(set)
    for _, t, _, s in rows:
        for x in (t or "").split("\n"):
            if x.strip():
                sites[x.strip()].add(s)
    for i, t, _, _ in rows:
        want = None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x.strip()]) < 4)
        assert got[i]["text"] == want
    assert got[0]["n_lines"] == 3 and got[0]["n_removed"] == 1 and got[100]["n_lines"] == 0
    assert lines.remove_boilerplate(no_docs).count() == 0


def _hits(text, windows):
    low = {c: c + 32 for c in range(65, 91)}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    hit, items = set(), set()
    for k in {len(w) for w in windows}:
        for i in range(len(words) - k + 1):
            if found := windows.get(tuple(words[i : i + k])):
                hit |= set(range(i, i + k))
                items |= found
    return len(words), hit, items


@pytest.mark.parametrize("blocks", [1, 2])
def test_decontamination(spark, odd, no_docs, blocks, monkeypatch):
    draw = random.Random(4)
    items = [(i, sentence(draw, draw.choice([3, 10, 14, 30]))) for i in range(25)] + [(90, None), (91, ""), (92, "one"), (93, "!!!"), (94, "Two, WORDS"), (1, "again the item")]
    windows = defaultdict(set)
    for i, t in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        k = min(10, len(words))
        for a in range(len(words) - k + 1 if k else 0):
            windows[tuple(words[a : a + k])].add(i)
    rows = list(odd)
    for i in range(20):
        own = sentence(draw, 40).split()
        own[7:7] = items[i][1].upper().split()[: draw.choice([5, 11, 40])]
        rows.append((700 + i, ", ".join(own), "en", "a"))
    if blocks > 1:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", 1500)
    docs = frame(spark, rows)
    got = decontam.find(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"]).withColumn("n_hit", decontam.hit_words()).withColumn("digest", decontam.items_digest()).collect()
    assert len(got) >= len(rows) - (1 if blocks > 1 else 0)  # repeated rows may share a row when blocks are merged
    for r in got:
        n, hit, found = _hits(r["text"], windows)
        assert (r["__n_words"], r["n_hit"], sorted(r["__items"])) == (n, len(hit), sorted(found))
        assert r["digest"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert {x for a, b in zip(r["__starts"], r["__ends"], strict=True) for x in range(a, b)} == hit
    assert decontam.find(no_docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).count() == 0
    assert decontam.find(docs, spark.createDataFrame([], "item_id long, text string"), ["doc_id"]).filter(F.size("__items") > 0).count() == 0


@given(st.lists(st.integers(2, 5), min_size=1, max_size=60), st.lists(st.integers(2, 6), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_fm_index_finds_all_places(body, pattern):
    seq = np.array([*body, 0], np.int64)
    index = decontam.FMIndex(seq, every=3)
    low, high = index.search(np.array([pattern], np.int64))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [i for i in range(len(body) - len(pattern) + 1) if body[i : i + len(pattern)] == pattern]


@given(st.integers(1, 6), st.integers(1, 70), st.integers(0, 2**32), st.sampled_from([2, 300, 65536]))
@settings(max_examples=40, deadline=None)
def test_codec_round_trip(lanes, steps, seed, top):
    blocks = np.random.default_rng(seed).integers(0, top, (lanes, steps))
    assert (codec.decode(codec.encode(blocks), steps) == blocks).all()


def test_codec_refuses_large_ids():
    with pytest.raises(ValueError, match="65536"):
        codec.encode(np.array([[65536]]))


def test_token_files(spark, odd_docs, odd, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = [(900, "it's don't (word), <|endoftext|> x<|endoftext|>y ＡＢ É́ 1234 a1b2 ...!!! 'S'LL", "en", "a"), (901, "tab\tand\x0bfeed\x0c  wide ΣΊΣΥΦΟΣ Straße. naïve, İx", "en", "a")]
    docs = frame(spark, odd + extra)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.round_trip(docs, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t, _, _ in sorted(odd + extra, key=lambda r: -1 if r[0] is None else r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]
        want.append((-1 if i is None else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(no_docs, path).count() == 0
    token_files.write(docs, path, str(tmp_path / "f"), file_ids=9000)
    assert spark.read.parquet(str(tmp_path / "f")).select("shard").distinct().count() > 2
    many = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(spark, str(tmp_path / "f")).collect()}
    assert {(-1 if a is None else a, b, c, d) for a, b, c, d in many} == set(want)
    damaged = spark.read.parquet(str(tmp_path / "f")).withColumn("crc32", F.col("crc32") + 1)
    damaged.write.parquet(str(tmp_path / "g"))
    with pytest.raises(Exception, match="damaged"):
        token_files.digests(spark, str(tmp_path / "g")).collect()


def test_language(spark, no_docs):
    draw = random.Random(6)
    letters = {"xx": "abcdef", "yy": "ghijkl", "zz": "öäüabc"}
    rows = [(i, " ".join("".join(draw.choice(letters[x]) for _ in range(draw.randint(2, 8))) for _ in range(40)), x, "a") for i, x in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(900, None, "xx", "a"), (901, "123 !?", "yy", "a"), (902, "", None, "a"), (903, "ghijkl ljkih", None, "a"), (904, "gh " * 30_000, None, "a")]
    docs = frame(spark, rows)
    model = language.fit(docs.filter(~language.held_out()))
    got = {r["doc_id"]: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert all(got[i]["__lang"] == x for i, _, x, _ in rows[:120])
    assert all(got[i]["__lang"] == "und" and got[i]["__score"] == 0 for i in (900, 901, 902))
    assert got[903]["__lang"] == got[904]["__lang"] == "yy"
    assert all(0 <= r["__score"] <= 1 for r in got.values())
    assert {r[0] for r in docs.filter(language.held_out()).select("doc_id").collect()} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert language.fit(no_docs) is None
    assert {r["__lang"] for r in language.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    assert language.predict(no_docs, model, ["doc_id"]).count() == 0


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(hit)


def test_quality_counts(spark, odd_docs, odd):
    cases = [(800, "a b c a b c\na b c\n\n a b c\na b c", "en", "a"), (801, "#*$%&|<> é́ 😀 x", "en", "a"), (802, "a a a a", "en", "a"), (803, "x\r\nx\r\nx", "en", "a")]
    known = {i: t for i, t, _, _ in odd + cases}
    for r in quality.judge(frame(spark, odd + cases), [], ["doc_id"]).collect():
        want = _counts(known[r["doc_id"]])
        assert tuple(r[f"__{c}"] for c in quality.COUNTS[:5]) == want, r["doc_id"]
        assert r["__base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["__kept"] == (not r["__base_failed"])


def test_decision_list(spark, no_docs):
    draw = random.Random(7)
    rows = []
    for i in range(300):
        words = sentence(draw, 80).split()
        if i % 4 == 0:
            words = [w + "***" for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "a"))
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300, 2)] + [(5000, 1), (None, 0), (4, None)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    assert rules
    got = {r["doc_id"]: r["__kept"] for r in quality.judge(docs, rules, ["doc_id"]).collect()}
    assert all(kept == (i % 4 != 0) for i, kept in got.items())
    assert quality.fit(docs, labels.limit(0)) == [] and quality.fit(no_docs, labels) == []
    assert quality.judge(no_docs, rules, ["doc_id"]).count() == 0
