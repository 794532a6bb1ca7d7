"""What the codec of token files costs, in bytes and in time, and blocks that end inside documents."""

import statistics
import time
import zlib

import numpy as np
import pyarrow as pa
import pyspark

from textquarry.llm import codec, token_files


def _ids(n, kinds=3000, seed=1):
    """Ids by a skewed law, a quarter of them foretold by the id before."""
    draw = np.random.default_rng(seed)
    share = 1 / (np.arange(kinds) + 20.0)
    names = draw.permutation(49_000)[:kinds]
    of = draw.choice(kinds, n, p=share / share.sum())
    for i in np.flatnonzero(draw.random(n - 1) < 0.25) + 1:
        of[i] = (of[i - 1] * 7 + 1) % kinds
    return names[of].astype(np.uint16)


def _size(payload):
    return len(payload) if isinstance(payload, bytes) else sum(map(len, payload))


def test_smaller_than_by_frequencies_alone():
    ids = _ids(1 << 19)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert _size(codec.encode(ids.reshape(-1, 1024))) * 8 < -(share * np.log2(share)).sum() * len(ids)


def test_time_by_id():
    def seconds(work):
        t = time.thread_time()
        work()
        return time.thread_time() - t

    ids = _ids(1 << 19).repeat(2).reshape(4096, 256)
    payload = codec.encode(ids)
    usual = statistics.median(seconds(lambda: sum(range(50_000))) for _ in range(99)) * 1000
    best = min(seconds(lambda: (codec.encode(ids), codec.decode(payload, 256))) for _ in range(3))
    assert best / ids.size * 1e6 / usual < 0.35


def test_blocks_end_inside_documents(monkeypatch):
    class Task:
        @staticmethod
        def get():
            return Task()

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    monkeypatch.setattr(token_files, "BLOCK", 1000)
    monkeypatch.setattr(token_files, "ROW", 100)
    monkeypatch.setattr(token_files, "LANES", 10)
    ids, sizes = _ids(7777), [1, 999, 1, 1999, 3500, 1, 1000, 276]
    ends = np.cumsum(sizes)
    docs = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([d.tobytes() for d in docs], pa.binary())], names=["doc_id", "ids"])
    blocks = list(token_files._blocks(iter([given.slice(0, 3), given.slice(3)])))
    assert [n for b in blocks for n in b.column("n_ids").to_pylist()] == [1000] * 7 + [777]
    pieces = [r for b in token_files._pieces(iter(blocks)) for r in b.to_pylist()]
    assert sum(p["n"] for p in pieces) == len(ids) and all(p["shard"] == 3 for p in pieces)
    for p in pieces:
        assert p["crc32"] == zlib.crc32(ids[p["at"] : p["at"] + p["n"]].astype("<u4").tobytes())
        assert ends[p["doc_no"]] - sizes[p["doc_no"]] <= p["at"] < p["at"] + p["n"] <= ends[p["doc_no"]]
    assert {p["doc_no"]: p["doc_id"] for p in pieces if p["doc_id"] is not None} == dict(enumerate(range(len(docs))))
