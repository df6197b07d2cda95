"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are made document by document on the executors. Distinct fingerprints are then joined
through bit masks built so that any two within the radius agree on all pinned bits of at least one
mask: bit i carries a non-zero vector of r+1 bits, mask v pins the bits whose vector has an odd
product with v, and for any r bits some v is orthogonal to all their vectors. Buckets are counted
before they are dealt out. One too large to compare inside is covered again, row by row where its
rows lie, by masks over the bits its mask left free. The first r+1 vectors are the unit vectors, so
each mask over more than r free bits pins one at least, and buckets shrink to 2^r fingerprints;
nothing is capped, and a bucket gives a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, ids_and_texts, lookup, materialize, smallest_ids, without_ids

#: Distinct fingerprints of one bucket that are compared with one another.
BUCKET = 256
#: Shingles whose hashes are held at once.
BLOCK = 8192
#: Values of pinned bits whose finer masks may be broadcast.
BROADCAST_MASKS = 100_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of text, A-Z lower-cased; no words: 0."""
    norm = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not norm:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(norm, np.uint8) == 32), len(norm))
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(ends))
    starts, ends = starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), BLOCK):
        raw = b"".join([digest(norm[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return run


def masks(free: int, radius: int) -> list[int]:
    """The bits to pin, one mask for each non-zero v, over the bits set in `free`: each pins at least
    one if more than `radius` are free."""
    bits = [b for b in range(64) if free >> b & 1]
    n = 2 ** (radius + 1) - 1
    vectors = sorted(range(1, n + 1), key=lambda v: (v.bit_count() > 1, v))
    return [sum(1 << b for j, b in enumerate(bits) if (v & vectors[j % n]).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def spanning(near: np.ndarray, reps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in near, a square of flags."""
    root = np.full(len(near), -1)
    edges = []
    for i in range(len(near)):
        if root[i] < 0:
            root[i], front = i, [i]
            while front:
                new = np.flatnonzero(near[front].any(axis=0) & (root < 0))
                root[new], front = i, new.tolist()
                edges += [(int(reps[i]), int(reps[j])) for j in front]
    return edges


def _forest(fps: np.ndarray, reps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among a bucket's fingerprints."""
    return spanning(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, reps)


def _links(radius: int):
    """Rows sorted by (pinned, key) as edges (a, b): each bucket's spanning forest. Holds a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(buckets: list[np.ndarray]) -> pa.RecordBatch:
            found = [e for rows in buckets if len(rows) > 1 for e in _forest(np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, 3], radius)]
            e = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        held = np.empty((0, 4), np.int64)
        for batch in batches:
            table = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)])
            cuts = np.flatnonzero((table[1:, :2] != table[:-1, :2]).any(axis=1)) + 1
            buckets = np.split(table, cuts)
            held = buckets.pop()
            yield edges(buckets)
        yield edges([held])

    return run


def _finer(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pinned in batch.column(0).to_pylist():
                whole = pinned & (2**64 - 1)
                found.append([_signed(whole | m) for m in masks(~whole & (2**64 - 1), radius)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["_p", "finer"])

    return run


def hamming_links(classes: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that tie together the classes (fp, rep; both longs, fp unique) with at most `radius` differing bits, directly or by way of others. No link is lost or added; an empty table
    has none. A `bucket` below 2^radius counts as that: so many may differ in the last free bits."""
    bucket = max(bucket, 2**radius)
    rows = classes.select("fp", "rep", F.explode(F.array(*[F.lit(_signed(m)) for m in masks(2**64 - 1, radius)])).alias("pinned"))
    found, level = [], 0
    while True:
        keyed = rows.select("pinned", F.col("fp").bitwiseAND(F.col("pinned")).alias("key"), "fp", "rep")
        large = materialize(keyed.groupBy("pinned", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "large")
        last = large.isEmpty()
        if not last:
            keyed = materialize(lookup(keyed, large, ["pinned", "key"], ["n"], "n", "fp"), "level")
        small = keyed if last else keyed.where("n is null")
        dealt = small.select("pinned", "key", "fp", "rep").repartition("pinned", "key").sortWithinPartitions("pinned", "key", "fp")
        found.append(materialize(dealt.mapInArrow(_links(radius), "a long, b long"), "links"))
        if last:
            break
        level += 1
        if level > 64:
            raise RuntimeError("a mask pinned no further bit")
        finer = materialize(large.select("pinned").distinct().mapInArrow(_finer(radius), "_p long, finer array<long>"), "masks")
        few = finer.limit(BROADCAST_MASKS + 1).count() <= BROADCAST_MASKS
        rows = keyed.where("n is not null").join(F.broadcast(finer) if few else finer, F.col("pinned") == F.col("_p")).select("fp", "rep", F.explode("finer").alias("pinned"))
        # two masks of a level can pin the same bits: a fingerprint goes there once
        rows = rows.distinct()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most `radius` bits; null if no row
    there has an id. Null and wordless texts have fingerprint zero, which links like any other. Any
    64-bit number is an id; rows that repeat an id are fingerprints of their own and are tied by
    links alone. Repeated ids and rows are all returned; an empty table gives an empty result.
    """
    if not 2 <= radius < 6:
        raise ValueError("radius must be 2 to 5")
    texts = ids_and_texts(docs, id_col, text_col)
    fps = materialize(texts.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long"), "fps")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    tied = smallest_ids(classes, components(hamming_links(classes.select("fp", F.col("fp").alias("rep")), radius, bucket)), "fp")
    out = lookup(fps, tied, ["fp"], ["component_id"], "n", "doc_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is not their component's. Rows that repeat an id share its
    verdict; rows with a null id are named by none and stay."""
    marked = near_duplicates(docs, radius, words, seed, id_col, text_col).where("doc_id <> component_id").select("doc_id")
    return without_ids(docs, materialize(marked, "near"), id_col)
