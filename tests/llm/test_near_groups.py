"""Large groups in the pipeline's near-dedup: work in proportion to their size, and nothing lost by it."""

import random

import numpy as np
import pyarrow as pa
import pytest

near_text = pytest.importorskip("vellum.llm.near_text")


def roots(n, pairs):
    """For each of n the smallest position reachable over pairs."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        i, j = sorted((top(i), top(j)))
        root[j] = i
    return [top(i) for i in range(n)]


class Read:
    """Sets that count the hashes read of them."""

    def __init__(self, sets):
        self.sets, self.n = sets, 0

    def __len__(self):
        return len(self.sets)

    def __getitem__(self, at):
        self.n += len(self.sets[at])
        return self.sets[at]


def group(size, seed=3):
    """size distinct fingerprints that differ from one another in a tenth of their bits."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, 64 * near_text.FP_WORDS, np.uint8)
    return [(bytearray(np.packbits(base ^ (rng.random(len(base)) < 0.05)).tobytes()),) for _ in range(size)]


@pytest.mark.parametrize("dense", [1024, 64])
def test_a_groups_bands_give_an_edge_a_fingerprint(spark, monkeypatch, dense):
    asked, components = [], near_text.components
    monkeypatch.setattr(near_text, "components", lambda edges: asked.append(edges.count()) or components(edges))
    fps = group(400)
    found = near_text.near_fingerprint_classes(spark.createDataFrame(fps, "fp binary"), dense=dense).collect()
    assert len(found) == len({bytes(f[:8]) for f, in fps}) and len({r.root for r in found}) == 1
    assert max(asked) <= 2 * 400


def test_contracted_edges_tie_the_same_nodes():
    rng = np.random.default_rng(1)
    for n, m in ((2, 1), (50, 30), (400, 380), (400, 4000)):
        edges = rng.integers(0, n, (m, 2))
        want = roots(n, edges.tolist())
        star = near_text.star_edges(edges)
        assert roots(n, star.tolist()) == want and len(star) == sum(r != i for i, r in enumerate(want))
        batches = [pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"]) for e in np.array_split(edges, 7)]
        for most in (3, 100, 10_000):
            out = [list(zip(*(c.to_pylist() for c in b.columns))) for b in near_text._thin(most)(iter(batches))]
            assert roots(n, [e for b in out for e in b]) == want


def test_sets_that_share_a_passage_are_not_compared_in_whole():
    rng, texts = np.random.default_rng(2), []
    common = rng.integers(0, 2**64, 60, np.uint64)
    for k in range(800):  # half of each is common to all: similarity 0.33
        texts.append(np.union1d(common, rng.integers(0, 2**64, 60, np.uint64)))
    for k in range(300):  # copies at the threshold, on both sides of it, in chains
        texts.append(np.union1d(texts[-1][:108], rng.integers(0, 2**64, 11 + k % 4, np.uint64)))
    texts += [np.empty(0, np.uint64)] * 3 + [texts[5][:4], np.append(texts[5][:4], texts[6][-1:])]
    texts = [np.unique(t) for t in texts]
    random.Random(1).shuffle(texts)
    pairs = []
    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    pairs.append((i, j))
    sets, sizes = Read(np.concatenate(texts)), np.array([len(t) for t in texts])
    edges = near_text.forest(sets, sizes, 0.8)
    assert len(pairs) > 100 and roots(len(texts), edges) == roots(len(texts), pairs)
    assert len(edges) == sum(r != i for i, r in enumerate(roots(len(texts), pairs)))
    assert sets.n <= 10 * len(sets)


@pytest.mark.parametrize("others", [0, 300])
def test_others_are_dealt_in_few_chunks(spark, others):
    n, bucket = 400, 4
    large = spark.range(n + others).selectExpr("id as key", "0L as band")
    found = spark.range(n).selectExpr("id as node", "0L as root")
    again = near_text._again(large, found, bucket)
    if not others:
        assert again is None
        return
    rows = {r.key: r.chunks for r in again.collect()}
    chunks = max(c for r in rows.values() for c in r) + 1
    assert len(rows) == n + others and chunks <= near_text.SPLIT * n / others + 1
    assert all(len(rows[i]) == 1 for i in range(n)) and all(rows[i] == list(range(chunks)) for i in range(n, n + others))
