"""The words of the range coder, carries included, and the numbers of known parts in token files."""

import time

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from textquarry.llm import codec, token_files


def test_words_are_the_exact_number():
    low, top, bits, steps = 0, (1 << 64) - 1, 12, 60
    spans, exact, scale, size = [], 0, 64, top
    target = 0x80000000  # parts of the range that hold this place keep the words before it open, until one carries
    for t in range(steps):
        unit, aim = size >> bits, (target << (scale - 32)) - exact
        at = min(4094, max(0, aim // unit - (aim % unit == 0))) if t < steps - 1 else 4095
        spans.append((at, 2 if at < 4095 else 1))
        exact, size = exact + unit * at, unit * spans[-1][1]
        if t % 2 and size < 1 << 32:
            exact, size, scale = exact << 32, size << 32, scale + 32
    assert scale > 64 + 3 * 32
    words = codec._written(1, steps, bits, lambda t: tuple(np.array([x], np.uint64) for x in spans[t]))
    assert int.from_bytes(words.astype(">u4").tobytes(), "big") == exact


def _names(n, seed=3):
    return ["".join(x) for x in np.random.default_rng(seed).choice(list("abcdefghij"), (n, 9))]


def test_known_parts_are_found_in_any_number():
    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"))
    few = pa.array(sorted(set(_names(1000))))

    def seconds():
        words.places(few)
        times = []
        for _ in range(5):
            t = time.thread_time()
            words.places(few)
            times.append(time.thread_time() - t)
        return min(times)

    before = seconds()
    words.places(pa.array(sorted(set(_names(300_000, 4)))))
    assert seconds() < 6 * before


def test_clashes_of_parts(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_BITS", 3)
    monkeypatch.setattr(token_files, "HASHED_BYTES", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    words, whole = token_files.Words(path), Tokenizer.from_file(path)
    texts = [" ".join(_names(40, s % 3)) + " It's x1, " + "long" * s for s in range(9)]
    for _ in range(2):
        ids, sizes = words.encode(pa.array(texts))
        want = [[*whole.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
