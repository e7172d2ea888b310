"""The parities of sets never tell apart what links, and a worker lets go what it no longer needs."""

import numpy as np
import pyarrow as pa

from inkgrove.llm import jaccard, vocab, worker


def _like(a: np.ndarray, keep: float, extra: int, rng: np.random.Generator) -> np.ndarray:
    return np.unique(np.concatenate([a[rng.random(len(a)) < keep], rng.integers(0, 1 << 63, extra, np.uint64)]))


def test_parities_keep_every_link_and_drop_most_others():
    rng = np.random.default_rng(5)
    links = others = dropped = 0
    for _ in range(600):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 3000)), np.uint64))
        b = _like(a, rng.choice([0.1, 0.8, 0.9, 1.0]), int(rng.integers(0, 1 + len(a) // 5)), rng)
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        link = 100 * both >= jaccard.PERCENT * (len(a) + len(b) - both)
        odd = [np.frombuffer(jaccard._parities(x), np.uint64)[None] for x in (a, b)]
        near = jaccard._near_enough(np.array([len(a)]), odd[0], np.array([len(b)]), odd[1])[0]
        assert near or not link
        links += link
        if both < 0.3 * len(a):
            others += 1
            dropped += not near
    assert links > 50 and others > 50 and dropped > 0.9 * others


def test_parities_at_the_limit():
    a = np.arange(9, dtype=np.uint64)  # 8 of 10 shared
    b = np.append(np.arange(8, dtype=np.uint64), np.uint64(20))
    odd = [np.frombuffer(jaccard._parities(x), np.uint64)[None] for x in (a, b)]
    assert jaccard._near_enough(np.array([9]), odd[0], np.array([9]), odd[1])[0]
    c = np.append(np.arange(7, dtype=np.uint64), np.array([20, 21], np.uint64))
    assert not jaccard._near_enough(np.array([9]), odd[0], np.array([9]), np.frombuffer(jaccard._parities(c), np.uint64)[None])[0]


def test_frugal_gives_the_same_batches_and_forgets():
    batches = [pa.RecordBatch.from_pydict({"x": [1, 2]}), pa.RecordBatch.from_pydict({"x": [3]})]
    vocab._loaded["none", False] = None
    assert list(worker.frugal(iter, vocab.forget_encoders)(iter(batches))) == batches
    assert not vocab._loaded
    assert list(worker.frugal(iter)(iter([]))) == []
