"""Operator 9: packing by best-fit decreasing.

Each task turns its share of the documents into pieces and packs them on its
own: full windows are cut from overlong documents first, the remainders go,
longest first, into the open window with the least room that still suffices.
A segment tree over the capacities finds that window.  Windows that keep more than
SLACK tokens free are opened again: the pieces of all tasks' open windows - a few
numbers each - are dealt out in groups of GROUP_PIECES and packed once more, so that
padding does not grow with the number of tasks.  A task's memory is a few numbers
per piece of its block or group.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bpe import MARKS, TrieBpe, chunks_of
from .common import Memo, blocks, read, settle, texts

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Most words in each generation of a Python worker's memory; documents handled at once.
CACHE = 400_000
BLOCK_DOCS = 500
#: Pieces that one task packs together; the next such block starts new windows.
BLOCK_PIECES = 500_000
#: Share of a window that may stay free without its pieces being packed again, and about how many pieces meet then in one task.
SLACK = 1 / 200
GROUP_PIECES = 250_000
#: Sequences of the second packing are numbered from here on; those of the first are below.
AGAIN = 1 << 61

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class CapacityTree:
    """Segment tree over 0..size: how many open windows have each remaining capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """Smallest capacity of at least ``need`` with an open window, or -1."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not self.count[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each length, and the number of sequences; best-fit decreasing."""
    tree, n = CapacityTree(window), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if need == window:
            sequence[i], n = n, n + 1
            continue
        room = tree.tightest(need)
        if room < 0:
            at, room, n = n, window, n + 1
        else:
            at = tree.take(room)
        sequence[i], offset[i] = at, window - room
        if room > need:
            tree.add(room - need, at)
    return sequence, offset, n


class IdBytes:
    """Ids of words as little-endian 32-bit numbers, each distinct word encoded by the library once while remembered."""

    #: A mark between a letter and white space is a word of its own.
    MARK = re.compile(r"[.,;:!?](?<=[a-zß-öø-ÿ][.,;:!?])(?=\s|\Z)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: The same model for words that are normalised and cut already.
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.words = Memo(CACHE)

    def cut(self, text: str) -> list[str]:
        """Words of a text; of one in Latin-1, in lower case and without the marks that end them, so that fewer are distinct."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return chunks_of(text)
        return chunks_of(text if "<|" in text else self.MARK.sub(r" \g<0>", text.lower()))

    @staticmethod
    def _each(library, keys: list[str], todo: list[str]) -> Iterator[tuple[str, bytes]]:
        if todo:
            got = library.encode(todo, is_pretokenized=True, add_special_tokens=False)
            raw, at = np.array(got.ids, dtype="<u4").tobytes(), 0
            counts = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(todo))
            for key, end in zip(keys, (4 * np.cumsum(counts)).tolist(), strict=True):
                yield key, raw[at:end]
                at = end

    def learn(self, words: set[str]) -> None:
        new = self.words.missing(words)
        plain = {w: w if w in MARKS else x[0] for w in new if w in MARKS or (x := TrieBpe.plain(w)) and len(x) == 1}
        self.words.now.update(self._each(self.model, list(plain), list(plain.values())))
        other = [w for w in new if w not in plain]
        self.words.now.update(self._each(self.library, other, other) if not any("<|" in w for w in other) else self._special(other))

    def _special(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """One by one, as a special token belongs to no word."""
        for w in words:
            yield w, np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, block: list[str]) -> Iterator[bytes]:
        cut = [self.cut(t) for t in block]
        self.learn(set().union(*cut))
        known = self.words.now.__getitem__
        for parts in cut:
            yield b"".join(map(known, parts))


class _Pieces:
    """Pieces of documents in arrays: the document's place, start, length, crc32 and the document's tokens."""

    def __init__(self) -> None:
        self.doc, self.start, self.length, self.crc, self.tokens = (array("q") for _ in range(5))

    def __len__(self) -> int:
        return len(self.doc)

    def cut(self, doc: int, raw: bytes, window: int) -> None:
        """Full windows first, then what is left."""
        n, view = len(raw) // 4, memoryview(raw)
        for start in range(0, n, window):
            piece = view[4 * start : 4 * (start + window)]
            self.doc.append(doc)
            self.start.append(start)
            self.length.append(len(piece) // 4)
            self.crc.append(zlib.crc32(piece))
            self.tokens.append(n)

    def packed(self, docs: list[pa.Array], window: int, first: int) -> tuple[Iterator[pa.RecordBatch], int]:
        """Record batches of these pieces in sequences from ``first`` on, null in windows left open, and the number of sequences."""
        columns = [np.frombuffer(x, np.int64) for x in (self.start, self.length, self.crc, self.tokens)]
        sequence, offset, n = best_fit(columns[1], window)
        free = window - np.bincount(sequence, columns[1], n)
        ids = pa.concat_arrays(docs).take(pa.array(np.frombuffer(self.doc, np.int64)))
        whole = pa.RecordBatch.from_arrays([ids, *map(pa.array, columns), pa.array(sequence + first, mask=free[sequence] > window * SLACK), pa.array(offset)], names=["doc_id", *PIECES])
        return (whole.slice(at, 100_000) for at in range(0, len(self), 100_000)), n


_encoders: dict[str, IdBytes] = {}


def encoder(path: str) -> IdBytes:
    if path not in _encoders:
        _encoders[path] = IdBytes(path)
    return _encoders[path]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``; a null or empty text is that id
    alone.  sequence_id is unique over all tasks (the task's number in the upper
    bits) and the same when a task runs again on the same input split.  Repeated
    rows are packed as documents of their own; pieces of equal length go in the order
    of the input; an empty table gives an empty result; other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = texts(docs, id_col, text_col).withColumn("part", F.spark_partition_id())
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(PIECE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        docs_: list[pa.Array] = []
        held = _Pieces()
        seen = first = part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for block in blocks(batch, BLOCK_DOCS):
                docs_.append(block.column("doc_id"))
                for raw in ids_of.encode(block.column("text").to_pylist()):
                    held.cut(seen, raw + end, window)
                    seen += 1
                if len(held) >= BLOCK_PIECES:
                    out, n = held.packed(docs_, window, (part << 33) + first)
                    yield from out
                    docs_, held, seen, first = [], _Pieces(), 0, first + n
        if len(held):
            yield from held.packed(docs_, window, (part << 33) + first)[0]

    return _again(settle(rows.mapInArrow(run, schema), "packed"), window)


def _again(pieces: DataFrame, window: int) -> DataFrame:
    """``pieces`` with those of open windows (sequence_id is null) packed once more, in groups of about GROUP_PIECES."""
    open_ = pieces.where("sequence_id is null")
    groups = open_.count() // GROUP_PIECES + 1
    # Dealt and sorted by what a piece is, so that a task that runs again sees the same pieces in the same order.
    what = ["length", "ids_crc32", "doc_id", "start", "doc_tokens"]
    dealt = open_.repartition(groups, F.xxhash64(*what)).sortWithinPartitions(*what).withColumn("part", F.spark_partition_id())
    schema = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        sequence, offset, _ = best_fit(whole["length"].to_numpy(), window)
        first = AGAIN + (whole["part"][0].as_py() << 33)
        whole = whole.select(schema.names[:-2]).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
        yield from whole.to_batches(100_000)

    return pieces.where("sequence_id is not null").unionByName(dealt.mapInArrow(run, schema))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
