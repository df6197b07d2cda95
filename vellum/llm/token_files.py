"""Token ids as flat files of unsigned integers with 64-bit document offsets.

Texts are encoded where they lie, before the shuffle; ids, not texts, are then dealt out by ranges of
doc_id that hold equally many bytes of text. One task writes a range in order, as parts of bounded size. A
part is three files: `.tok` (ids, little-endian), `.off` (where each document begins, and the end;
unsigned 64-bit, in ids) and `.doc` (doc_ids, signed 64-bit). Files are written under a name of that
attempt's own, then renamed, so a repeated task leaves whole parts. A part's base is the prefix sum
of the sizes of the parts before it. Readers map the files into memory.
"""

from __future__ import annotations

import glob
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import ids_and_texts, materialize, scratch
from .bpe import Memo, byte_letters, gather, in_small_batches

#: Bytes of ids in one part, and writing tasks at most.
PART_BYTES, TASKS = 32 << 20, 10_000
#: Cells of a histogram of ids, and how often a cell is cut into cells of its own: 4 times 16 bits are an id.
CELLS, LEVELS = 1 << 16, 4
#: Words in one generation of the memo: a word that is worked out anew costs ten times as much here as in `bpe`.
WORDS = 300_000
#: Bytes of text in one batch of the encoder.
OUT_BYTES = 8 << 20
#: Documents in one output batch of the reader.
READ_DOCS = 4096


class WordEncoder:
    """A `tokenizers` vocabulary applied word by word: where the normaliser and the pre-tokenizer
    treat white space as a mere separator, a text's ids are its words' ids in a row. `by_word` is
    checked from the vocabulary file; other vocabularies encode whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = drops_space(json.load(open(path, encoding="utf-8")))
        tokenize = self.tokenizer.model.tokenize
        letters = dict(enumerate(byte_letters()))
        self.letters = Memo(lambda w: array("I", [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(letters))]).tobytes(), WORDS)
        self.words = Memo(self.word, WORDS)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Latin letters alone are in normal form, have one lower case each and are one pre-token: they
        go to the model. A mark after them is a pre-token of its own."""
        if word.isalpha():
            stem, mark = word, b""
        elif word[-1:] in (".", ",", "!", "?") and word[:-1].isalpha():
            stem, mark = word[:-1], self.words[word[-1]]
        else:
            return self.ids(word) if word else b""
        if stem.isascii() or max(stem) < "\u0250" and "\u0130" not in stem:
            return self.letters[stem.lower()] + mark
        return self.ids(word)

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, each with `end` behind it, and how many each has. A batch's
        distinct words are worked out once each."""
        if not self.by_word:
            packed = [self.ids(t) + np.array([end], "<u4").tobytes() for t in texts.to_pylist()]
            return gather(packed, np.arange(len(packed), dtype=np.int32), np.arange(len(packed)))
        if len(texts) == 1 and len(texts[0].as_py()) > OUT_BYTES:
            parts = [self.by_words(pa.array([p]), end)[0][:-1] for p in in_parts(texts[0].as_py(), OUT_BYTES // 2)]
            ids = np.concatenate([*parts, np.array([end], "<u4")])
            return ids, np.array([len(ids)])
        return self.by_words(texts, end)

    def by_words(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.compute.ascii_split_whitespace(texts)
        words, many = lists.flatten().dictionary_encode(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        packed = [*map(self.words.__getitem__, words.dictionary.to_pylist()), np.array([end], "<u4").tobytes()]
        last = np.cumsum(many + 1) - 1
        at = np.full(len(words) + len(many), len(packed) - 1, np.int32)
        inside = np.ones(len(at), bool)
        inside[last] = False
        at[inside] = words.indices.to_numpy()
        return gather(packed, at, last - many)


def in_parts(text: str, size: int) -> Iterator[str]:
    """A text cut where white space begins, into parts of about `size` characters (a longer word stays whole)."""
    at, blank = 0, re.compile(r"[ \t-\r]")
    while at < len(text):
        found = blank.search(text, at + size)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def drops_space(spec: dict) -> bool:
    """True if the vocabulary file's pipeline is: NFC, white-space runs to one space and lower case,
    then matches of a pattern that no white space is part of."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True and r"[^\s\p{L}\p{N}]+" in (split.get("pattern") or {}).get("Regex", "") and not any(t["single_word"] for t in spec.get("added_tokens", []))


@lru_cache(maxsize=4)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def local(path: str) -> str:
    """The mounted folder behind a path; files that are mapped into memory need one."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files are mapped into memory and need a mounted folder, not {path}")
    return url.path


def part_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most doc_id, by binary search; null: 0."""
    if not bounds:
        return F.lit(0)
    known, steps = F.array(*[F.lit(b).cast("long") for b in bounds]), len(bounds).bit_length()

    def narrow(lo: Column, k: Column) -> Column:
        mid = lo + F.call_function("shiftright", F.lit(1 << steps), k)
        return F.when((mid <= len(bounds)) & (F.get(known, mid - 1) <= doc_id), mid).otherwise(lo)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), narrow)


def equal_ranges(sizes: DataFrame, tasks: int) -> list[int]:
    """At most about 2 * tasks ascending bounds that cut sizes(doc_id, n) into ranges of about equal n.

    A histogram of at most CELLS cells over the ids is cut where a range is full; a cell that alone
    holds more than a range is a histogram of its own, down to single ids. What reaches the driver is
    CELLS rows for each histogram, and there are at most LEVELS * tasks of them, whatever the table holds.
    """
    known = sizes.where("doc_id is not null")
    low, high, whole = known.agg(F.min("doc_id"), F.max("doc_id"), F.sum("n")).first()
    if low is None or tasks < 2:
        return []
    full, bounds, open_spans = ceil(whole / tasks), set(), [(low, high)]
    for _ in range(LEVELS):
        heavy = []
        for lo, hi in open_spans:
            width = (hi - lo) // CELLS + 1
            place = f"(doc_id - {lo}) div {width}" if hi - lo < 1 << 62 else f"(cast(doc_id as decimal(38,0)) - {lo}) div {width}"
            cell = F.expr(place).cast("long")
            found = known.where(F.col("doc_id").between(lo, hi)).groupBy(cell.alias("c")).agg(F.sum("n").alias("n")).collect()
            held = 0
            for c, n in sorted((r["c"], r["n"]) for r in found):
                begin = lo + c * width
                if held and held + n > full:
                    bounds.add(begin)
                    held = 0
                held += n
                if n > full:
                    bounds |= {begin, begin + width}
                    held = 0
                    if width > 1:
                        heavy.append((begin, min(hi, begin + width - 1)))
        open_spans = heavy
        if not heavy:
            break
    return sorted(b for b in bounds if low < b <= high)


def _encoder(tokenizer: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        size = np.dtype(dtype).itemsize
        for batch in in_small_batches(batches, 1, OUT_BYTES):
            ids, n = encoder.encode_all(batch.column(1), end_id)
            ends = np.concatenate([[0], np.cumsum(n) * size]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype(dtype).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), raw], ["doc_id", "n", "ids"])

    return run


def _writer(folder: str, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        done: list[tuple[int, int, int, int, int]] = []
        now, files, at, docs, nulls, written = None, [], 0, 0, 0, 0

        def close() -> None:
            if now is not None:
                files[1].write(np.array([at], "<u8").tobytes())
                for f, kind in zip(files, ("tok", "off", "doc")):
                    f.close()
                    os.replace(f.name, f"{folder}/{now[0]:06d}-{now[1]:06d}.{kind}")
                done.append((*now, docs, at, nulls))

        try:
            for batch in batches:
                for task, doc_id, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if now is None or now[0] != task or written >= part_bytes:
                        close()
                        now = (task, now[1] + 1 if now and now[0] == task else 0)
                        at = docs = nulls = written = 0
                        files = [open(f"{folder}/.{now[0]:06d}-{now[1]:06d}.{kind}.{attempt}", "wb") for kind in ("tok", "off", "doc")]
                    files[0].write(ids)
                    files[1].write(np.array([at], "<u8").tobytes())
                    files[2].write(np.array([doc_id or 0], "<i8").tobytes())
                    at, docs, nulls, written = at + n, docs + 1, nulls + (doc_id is None), written + len(ids)
            close()
        except BaseException:
            for f in files:
                f.close()
                if os.path.exists(f.name):
                    os.remove(f.name)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in range(5)], ["task", "seq", "docs", "ids", "nulls"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, dtype: str = "<u2", part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs in ascending doc_id order and returns the manifest: part (from 0), docs, ids,
    nulls, base, path (of the part, without suffix), dtype. `folder` must be mounted on every executor
    (default: under the shared checkpoint folder); dtype `<u2` or `<u4` must hold the vocabulary.

    Null texts are empty: the end id alone. Null ids come first; rows that repeat an id follow one
    another by length and then by ids, and lie with one task, which streams them. An empty table
    writes no part.
    """
    spark = docs.sparkSession
    rows = ids_and_texts(docs, id_col, text_col)
    sizes = materialize(rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("n")), "sizes")
    bounds = equal_ranges(sizes, min(TASKS, ceil((sizes.agg(F.sum("n")).first()[0] or 0) / (2 * part_bytes))))
    encoded = rows.mapInArrow(_encoder(tokenizer, end_id, dtype), "doc_id long, n long, ids binary")
    target = local(folder or scratch(spark, "tokens"))
    os.makedirs(target, exist_ok=True)
    dealt = encoded.select(part_of(F.col("doc_id"), bounds).alias("task"), "doc_id", "n", "ids").repartitionById(len(bounds) + 1, F.col("task")).sortWithinPartitions("doc_id", "n", "ids")
    written = materialize(dealt.mapInArrow(_writer(target, part_bytes), "task long, seq long, docs long, ids long, nulls long"), "parts")
    for left in glob.glob(f"{target}/.*-*.*.*"):  # of executors that were lost
        os.remove(left)
    # prefix sums in two levels: over the tasks, of which there is a bounded number, then inside each
    before = (W.unboundedPreceding, -1)
    tasks = written.groupBy("task").agg(F.sum("ids").alias("all_ids"), F.count("*").alias("all_parts"))
    over = W.orderBy("task").rowsBetween(*before)
    tasks = tasks.select("task", F.coalesce(F.sum("all_ids").over(over), F.lit(0)).alias("b0"), F.coalesce(F.sum("all_parts").over(over), F.lit(0)).alias("p0"))
    inside = W.partitionBy("task").orderBy("seq").rowsBetween(*before)
    base = F.col("b0") + F.coalesce(F.sum("ids").over(inside), F.lit(0))
    path = F.format_string(f"{target}/%06d-%06d", "task", "seq")
    return written.join(F.broadcast(tasks), "task").select((F.col("p0") + F.col("seq")).alias("part"), "docs", "ids", "nulls", base.alias("base"), path.alias("path"), F.lit(dtype).alias("dtype"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base, dtype, nulls in zip(*(batch.column(i).to_pylist() for i in range(4))):
            docs = np.memmap(f"{path}.doc", "<i8", "r")
            starts, ids = np.memmap(f"{path}.off", "<u8", "r"), np.memmap(f"{path}.tok", dtype, "r")
            for at in range(0, len(docs), READ_DOCS):
                cut = starts[at : at + READ_DOCS + 1].astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:])]
                names = np.array(docs[at : at + READ_DOCS])
                unnamed = np.arange(at, at + len(names)) < nulls
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=unnamed), pa.array(cut[:-1] + base), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32. Parts are dealt out in turn."""
    spark = manifest.sparkSession
    files = materialize(manifest, "manifest")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    dealt = files.repartitionById(tasks, F.pmod(F.col("part"), F.lit(tasks)).cast("int")).select("path", "base", "dtype", "nulls")
    return dealt.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
