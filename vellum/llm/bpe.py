"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Text enters in pieces that end where a white-space run begins, a boundary that no pre-token spans.
A pre-token longer than the window is fed through a buffer: its tokens are emitted once they end at
least `lookahead` bytes before the end of what has been read. The lookahead comes from the merge
list alone: input still to come can move the last differing boundary to the left only by a chain of
merges of rising rank, where each next one's right part begins with the left part of the one before
(see `sufficient_lookahead`). Memory is the window, the lookahead and a bounded memo of pieces.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ids_and_texts

#: Fixed value: white space as the tokenizer's pattern knows it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces in one generation of the memo, bytes of a pre-token merged at once, characters of a text split at once, bytes of text in one output batch.
MEMO, WINDOW, CHUNK, OUT_BYTES = 60_000, 1024, 1 << 18, 2 << 20
#: Stands for a pair that does not merge; bytes of a pre-token that is merged together with others.
NO_MERGE, SHORT = 1 << 62, 48
#: Fixed value: white space as Python's and RE2's patterns can both name it.
BLANK = r"[ \t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space with no non-space beside it.
GAP = rf"{BLANK} (?:{BLANK}|\z)"


class Memo(dict):
    """A map from piece to result that is worked out on first use. Two generations: when the young
    one is full it becomes the old one, so at most 2 * limit results are held."""

    def __init__(self, work, limit: int = MEMO):
        super().__init__()
        self.work, self.limit, self.old = work, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value


class PairTable:
    """A map from pairs of ids to ranks and joined ids that whole arrays are looked up in. Levels of
    open tables, each with a hash of its own: what collides in one goes to the next."""

    def __init__(self, merge: dict[int, int], bits: int = 19):
        self.levels, self.shift = [], np.uint64(64 - bits)
        keys, values = np.array(list(merge), np.int64), np.array(list(merge.values()), np.int64)
        rnd = np.random.default_rng(7)
        while len(keys):
            odd = np.uint64(rnd.integers(1 << 62) * 2 + 1)
            slot = (keys.view(np.uint64) * odd) >> self.shift
            table, held = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_MERGE, np.int64)
            table[slot] = keys  # of keys that share a slot one stays
            placed = table[slot] == keys
            held[slot[placed]] = values[placed]
            self.levels.append((odd, table, held))
            keys, values = keys[~placed], values[~placed]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, NO_MERGE, np.int64)
        for odd, table, held in self.levels:
            slot = (keys.view(np.uint64) * odd) >> self.shift
            found = table[slot] == keys
            out[found] = held[slot[found]]
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


def gather(packed: list[bytes], at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the pieces numbered `at` in a row, how many lie between one place of `first` and the
    next). packed: the ids of each distinct piece, as unsigned 32-bit integers."""
    sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
    flat = np.frombuffer(b"".join(packed), "<u4")
    n = sizes[at]
    ends = np.cumsum(n, dtype=np.int32)
    where = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[at] - (ends - n), n)
    where += np.arange(len(where), dtype=np.int32)
    return flat[where], np.add.reduceat(n, first, dtype=np.int64) if len(first) else np.empty(0, np.int64)


class ByteBpe:
    def __init__(self, path: str, window: int = WINDOW):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.first = [vocab[c] for c in letters]
        self.text_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.shift = max(self.text_of).bit_length()
        self.low = (1 << self.shift) - 1
        self.merge = {}
        made = set(self.first)
        for rank, (a, b, ab) in enumerate(self.rules):
            if a not in made or b not in made:
                raise ValueError("the merge list is not proper: a rule comes before what it joins")
            made.add(ab)
            self.merge.setdefault(a << self.shift | b, rank << self.shift | ab)
        self.pairs, self.firsts = PairTable(self.merge), np.array(self.first, np.int64)
        self.lookahead = sufficient_lookahead(self.rules, {i: len(t) for i, t in self.text_of.items()})
        self.window = max(window, 2 * self.lookahead)
        self.split = regex.compile(PRE_TOKEN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = Memo(lambda piece: self.packed(" " + piece))
        self.whole = Memo(self.packed, MEMO // 8)
        self.gap = re.compile(r"\s (?:\s|\Z)")

    def merged(self, raw: bytes) -> list[int]:
        """Token ids of raw: the lowest-ranked pair joins first, the leftmost of equals."""
        first, shift, low, get, none = self.first, self.shift, self.low, self.merge.get, 1 << 62
        ids = [first[b] for b in raw]
        ranks = [get(a << shift | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = best & low
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << shift | new, none)
            if i < len(ranks):
                ranks[i] = get(new << shift | ids[i + 1], none)
        return ids

    def merged_all(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of short pre-tokens, all at once: in each turn every one of them that still can
        makes its lowest-ranked, leftmost merge."""
        out: list[bytes] = [b""] * len(raws)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        for lo, hi in ((1, 6), (7, 12), (13, 24), (25, SHORT)):
            rows = np.flatnonzero((sizes >= lo) & (sizes <= hi))
            if not len(rows):
                continue
            n, width = sizes[rows], int(sizes[rows].max())
            col = np.arange(width + 1)
            ids = np.full((len(rows), width + 1), -1, np.int64)
            ids[col < n[:, None]] = self.firsts[np.frombuffer(b"".join([raws[i] for i in rows.tolist()]), np.uint8)]
            ranks = np.full((len(rows), width + 1), NO_MERGE, np.int64)
            inside = (col + 1) < n[:, None]
            ranks[inside] = self.pairs((ids[:, :-1] << self.shift | ids[:, 1:])[inside[:, :-1]])
            while True:
                at = ranks.argmin(axis=1)
                each = np.arange(len(rows))
                best = ranks[each, at]
                done = best == NO_MERGE
                if done.any():
                    final, size = ids[done].astype("<u4"), n[done].tolist()
                    for i, row, k in zip(rows[done].tolist(), final, size):
                        out[i] = row[:k].tobytes()
                    if done.all():
                        break
                    ids, ranks, n, rows, at, best = ids[~done], ranks[~done], n[~done], rows[~done], at[~done], best[~done]
                    each = np.arange(len(rows))
                    width = int(n.max())
                    ids, ranks, col = ids[:, : width + 1], ranks[:, : width + 1], col[: width + 1]
                after = col[:-1] > at[:, None]
                ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
                ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
                new = best & self.low
                ids[each, at] = new
                n = n - 1
                ends = at + 1 < n
                right = np.full(len(rows), NO_MERGE, np.int64)
                right[ends] = self.pairs(new[ends] << self.shift | ids[each[ends], at[ends] + 1])
                ranks[each, at] = right
                begins = at > 0
                ranks[each[begins], at[begins] - 1] = self.pairs(ids[each[begins], at[begins] - 1] << self.shift | new[begins])
        return out

    def learn(self, pieces: list[str], lead: str) -> list[bytes]:
        """Packed ids of pieces, their short pre-tokens merged all at once."""
        tokens: list[str] = []
        many = []
        for p in pieces:
            found = self.split(lead + p)
            many.append(len(found))
            tokens += found
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        raws = [t.encode() for t in coded.dictionary.to_pylist()]
        packed = self.merged_all([t if len(t) <= SHORT else b"" for t in raws])
        for i, t in enumerate(raws):
            if len(t) > SHORT:
                packed[i] = array("I", self.merged(t) if len(t) <= self.window else self.stream([t])).tobytes()
        ends = np.cumsum(many)
        ids, sizes = gather(packed, coded.indices.to_numpy(), np.array(ends - many)) if len(tokens) else (np.empty(0, "<u4"), np.zeros(len(pieces), np.int64))
        raw, cut = ids.tobytes(), [0, *(np.cumsum(sizes) * 4).tolist()]
        return [raw[x:y] for x, y in zip(cut, cut[1:])]

    def known(self, memo: Memo, pieces: list[str], lead: str) -> list[bytes]:
        """Packed ids of a batch's distinct pieces."""
        out, old = list(map(memo.get, pieces)), memo.old
        gaps = [i for i, x in enumerate(out) if x is None]
        for i in gaps:
            if (ids := old.get(pieces[i])) is not None:
                out[i] = ids
                memo.put(pieces[i], ids)
        gaps = [i for i in gaps if out[i] is None and (lead or pieces[i])]
        for i, ids in zip(gaps, self.learn([pieces[i] for i in gaps], lead)):
            out[i] = ids
            memo.put(pieces[i], ids)
        return [b"" if x is None else x for x in out]

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one pre-token that comes in parts, each as soon as no further input can
        change it. Holds window bytes besides a part."""
        held = b""
        for part in parts:
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                if len(held) <= self.window:
                    continue
                done = 0
                for i in self.merged(held):
                    end = done + len(self.text_of[i])
                    if end > len(held) - self.lookahead:
                        break
                    yield i
                    done = end
                held = held[done:]
        yield from self.merged(held)

    def packed(self, piece: str) -> bytes:
        """Ids of a piece, as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        for token in self.split(piece):
            raw = token.encode("utf-8", "surrogatepass")
            ids += self.merged(raw) if len(raw) <= self.window else self.stream([raw])
        return array("I", ids).tobytes()

    def pieces(self, text: str) -> Iterator[bytes]:
        """Packed ids, piece by piece."""
        for at, part in enumerate(self.cut.split(text)) if self.cut and any(t in text for t in self.special) else ((0, text),):
            if at % 2:
                yield np.array([self.special[part]], "<u4").tobytes()
            else:
                yield from self.plain(part)

    def plain(self, text: str) -> Iterator[bytes]:
        """A text without special tokens. Where each space has a non-space beside it, pieces are what
        lies between spaces; elsewhere white-space runs matter and pre-tokens are the pieces."""
        at = 0
        while at < len(text):
            to = len(text)
            if to - at > CHUNK:
                to = self.boundary(text, at + CHUNK)
            part = text[at:to]
            at = to
            if self.gap.search(part):
                yield from map(self.whole.__getitem__, self.split(part))
            else:
                words = part.split(" ")
                if words[0]:
                    yield self.whole[words[0]]
                yield from map(self.inner.__getitem__, words[1:])

    @staticmethod
    def boundary(text: str, at: int) -> int:
        """The first place from `at` on where white space begins, or the end."""
        found = re.compile(r"(?<=\S)(?=[ \n])").search(text, at)
        return found.start() if found else len(text)

    def pieces_of(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """For texts whose pieces are what lies between spaces: the packed ids of each distinct piece,
        the piece at each place, and the place where each text begins."""
        lists = pa.compute.split_pattern(texts, " ")
        values, many = lists.flatten(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        first = np.cumsum(many, dtype=np.int64) - many
        later = np.ones(len(values), bool)
        later[first] = False
        inner, whole = values.filter(pa.array(later)).dictionary_encode(), values.take(pa.array(first)).dictionary_encode()
        packed = self.known(self.inner, inner.dictionary.to_pylist(), " ") + self.known(self.whole, whole.dictionary.to_pylist(), "")
        at = np.empty(len(values), np.int32)
        at[later] = inner.indices.to_numpy()
        at[first] = whole.indices.to_numpy() + len(inner.dictionary)
        return packed, at, first

    def one_by_one(self, texts: pa.Array) -> np.ndarray:
        """Which texts have special tokens, white space in runs or great length."""
        odd = pa.compute.or_(pa.compute.match_substring_regex(texts, GAP), pa.compute.greater(pa.compute.binary_length(texts), CHUNK))
        for t in self.special:
            odd = pa.compute.or_(odd, pa.compute.match_substring(texts, t))
        return odd.to_numpy(zero_copy_only=False)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has. A batch's distinct pieces are worked out once each."""
        odd = self.one_by_one(texts)
        ids, n = gather(*self.pieces_of(texts.filter(pa.array(~odd))))
        if not odd.any():
            return ids, n
        alone = [np.frombuffer(b"".join(self.pieces(t)), "<u4") for t in texts.filter(pa.array(odd)).to_pylist()]
        many = np.empty(len(texts), np.int64)
        many[~odd], many[odd] = n, [len(a) for a in alone]
        before = np.where(odd, 0, many).cumsum()[odd]
        parts = np.split(ids, before)
        return np.concatenate([x for pair in zip(parts, alone) for x in pair] + [parts[-1]]), many

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        odd = self.one_by_one(texts)
        many = np.empty(len(texts), np.int64)
        many[odd] = [sum(map(len, self.pieces(t))) // 4 for t in texts.filter(pa.array(odd)).to_pylist()]
        packed, at, first = self.pieces_of(texts.filter(pa.array(~odd)))
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        many[~odd] = np.add.reduceat(sizes[at], first, dtype=np.int64) if len(first) else 0
        return many

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(text)), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        state = Decoder(self)
        return "".join([state.feed(ids), state.end()])


def sufficient_lookahead(rules: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes b such that a token which ends b bytes before the end of a prefix is the same whatever
    follows the prefix.

    Let two runs, over the prefix and over a longer text, agree up to some boundary. A merge (u, v)
    made in only one of them has u left of the boundary and v right of it; it moves the boundary
    left by |u|. The v it needs starts where the boundary is, so its left spine holds the u of the
    merge that moved the boundary there, which had a lower rank. The longest such chain, found in
    one pass over the rules by rank, is the bound.
    """
    left = {ab: a for a, _, ab in rules}
    reach: dict[int, int] = {}
    most = 0
    for u, v, _ in rules:
        far, part = 0, v
        while part is not None:
            far = max(far, reach.get(part, 0))
            part = left.get(part)
        far += size[u]
        reach[u] = max(reach.get(u, 0), far)
        most = max(most, far)
    return most


class Decoder:
    """Byte-to-text state machine: feeds on ids, gives text up to the last whole character; bytes
    that are no UTF-8 become U+FFFD."""

    def __init__(self, bpe: ByteBpe):
        self.bytes_of = bpe.text_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def in_small_batches(batches: Iterable[pa.RecordBatch], text_at: int = 1, size: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + size)))
            yield batch.slice(at, to - at)
            at = to


def _encoder(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in in_small_batches(batches):
            ids, n = bpe.encode_all(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(n)])
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4")))]
            if decoded:
                columns.append(pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def encode_documents(docs: DataFrame, tokenizer: str, decoded: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (the text of those ids).

    Null texts are encoded as empty ones: no ids. Special tokens written in a text become their ids,
    none are added. Ids, null or repeated, are carried through; an empty table gives an empty result.
    `tokenizer` is the path of a byte-level BPE vocabulary file, readable on every executor.
    """
    return ids_and_texts(docs, id_col, text_col).mapInArrow(_encoder(tokenizer, decoded), "doc_id long, ids array<int>" + ", decoded string" * decoded)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in in_small_batches(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(bpe.count_all(batch.column(0)))], ["n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(n_tokens) of each row's whole text; null is empty."""
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(_counter(tokenizer), "n_tokens long")
