"""Sum-of-squares online packing of tokenised documents into windows.

Each document goes where the sum over fill levels of squared numbers of partly filled windows stays least: into an open window at some
level, or a new one. The numbers are kept in a level array; what a level's windows hold is kept beside it, and a window that is full is
handed on, so a task holds under ``window`` open windows' pieces at a time in practice. Of documents longer than a window, whole windows are cut off.
At a task's end its open windows are merged: their pieces are cut freely to fill windows, so a task pads one window at most, and that
one only up to the next power of two.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, small, span_hashes, text_pieces

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in OUT.split(", ")]

#: White space beyond ASCII, after which texts aren't split; and a string that the tokenizer reads as one id.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|endoftext\\|>")
#: One of these bytes is in all that ODD finds.
_HINT = np.zeros(256, bool)
_HINT[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, ord("<")]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


class Encoder:
    """Token ids of texts, equal to those of ``tokenizers`` with the vocabulary of byte_bpe_50k.json.

    This vocabulary never joins a single blank or line feed, nor a mark after an ASCII letter, to what stands before it. So a text falls
    into segments that begin with one, each is encoded once and remembered by a hash of 128 bits, up to ``most`` segments. Texts with other
    white space, or with the text of the special token, are encoded whole by ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes; of each a second one, and the place
        self.check = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids: np.ndarray = np.zeros(1 << 20, np.uint32)
        self.ends: np.ndarray = np.zeros(1 << 18, np.int64)
        self.n = 0

    def _learn(self, segments: list[str]) -> None:
        made = list(map(self.fast._core_bpe.encode_ordinary, segments))
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.uint32, int(lengths.sum()))
        last = int(self.ends[self.n])
        while last + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(made) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[last : last + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(made)] = last + np.cumsum(lengths)
        self.n += len(made)

    def piece(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts in ``data``."""
        space = _SPACE[data]
        ink = ~space
        cut = np.zeros(len(data), bool)
        if len(data) > 2:
            cut[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & ink[:-2] & ink[2:]
            cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        cut[inner[inner > 0] - 1] = False  # the last character of a text
        cut[inner] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
        hashes, second = span_hashes(data, starts, ends), span_hashes(data, starts, ends, 1)
        order = np.argsort(hashes)
        sorted_ = hashes[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = sorted_[1:] != sorted_[:-1]
        unique, first = sorted_[fresh], order[fresh]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(fresh) - 1
        if self.n + len(unique) > self.most:
            self._forget()
        there = np.searchsorted(self.known, unique)
        hit = there < len(self.known)
        hit[hit] = self.known[there[hit]] == unique[hit]
        if (second != second[first][back]).any() or (self.check[there[hit]] != second[first[hit]]).any():
            return self._one_by_one(data, offsets)
        places = np.full(len(unique), -1, np.int64)
        places[hit] = self.place[there[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            raw, n = data.tobytes(), self.n
            self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            places[new] = np.arange(n, n + len(new))
            self.known, self.check, self.place = (np.insert(x, there[new], y) for x, y in ((self.known, unique[new]), (self.check, second[first[new]]), (self.place, places[new])))
        at = places[back]
        begin, length = self.ends[at], self.ends[at + 1] - self.ends[at]
        total = np.concatenate(([0], np.cumsum(length)))
        flat = self.ids[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, offsets)]
        return [flat[bounds[k] : bounds[k + 1]] for k in range(len(offsets) - 1)]

    def _one_by_one(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The same without what is remembered, for segments that differ and share a hash."""
        parts = (data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        return [np.array(self.whole.encode(x, add_special_tokens=False).ids, np.uint32) for x in parts]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        for i, j, data, offsets in text_pieces(column):
            odd = _HINT[data].any() and ODD.search(data.tobytes().decode("utf-8", "replace"))
            ids = self.piece(data, offsets) if not odd else None
            for k in range(j - i):
                if odd:
                    part = data[offsets[k] : offsets[k + 1]]
                    text = part.tobytes().decode("utf-8", "replace")
                    if ODD.search(text):
                        yield np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                    else:
                        yield self.piece(part, np.array([0, len(part)]))[0]
                else:
                    yield ids[k]


class SumOfSquares:
    """Open windows by fill level, and the choice of a level for a size."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def level_for(self, size: int) -> int:
        """The level at which a document of this size adds least to the sum of squares; the fullest of equals."""
        top = self.window - size
        counts = self.counts
        # a window leaves level h (2 counts - 1 less) and comes to level h + size (2 counts + 1 more); full ones don't count
        change = 2 * counts[size : size + top + 1] + 1
        change[-1] = 0
        change = change - (2 * counts[: top + 1] - 1)
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1 if top else 0  # a new window leaves no level
        return top - int(np.argmin(change[::-1]))

    def put(self, size: int, piece) -> list | None:
        """Place a piece; the pieces of the window if that fills it."""
        h = self.level_for(size)
        held = []
        if h:
            held = self.open[h].pop()
            self.counts[h] -= 1
        held.append(piece)
        if h + size == self.window:
            return held
        self.open[h + size].append(held)
        self.counts[h + size] += 1
        return None

    def rest(self) -> Iterator:
        """All pieces of open windows, the fullest windows first."""
        for level in reversed(self.open):
            for held in level:
                yield from held


class Packer:
    """Rows of packed pieces; sequence ids of a task begin at ``first``."""

    def __init__(self, window: int, first: int) -> None:
        self.window, self.next = window, first
        self.levels = SumOfSquares(window)
        self.rows: list[tuple] = []

    def _write(self, held: list) -> None:
        at = 0
        for doc, start, ids, total in held:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self._write([(doc, at, ids[at : at + self.window], n)])
            at += self.window
        if at < n and (full := self.levels.put(n - at, (doc, at, ids[at:].copy() if at else ids, n))):  # no view of a long text's ids
            self._write(full)

    def taken(self) -> list[tuple]:
        """The rows made since the last call."""
        made, self.rows = self.rows, []
        return made

    def finish(self) -> None:
        held, fill = [], 0
        for doc, start, ids, total in self.levels.rest():
            at = 0
            while at < len(ids):
                part = ids[at : at + self.window - fill]
                held.append((doc, start + at, part, total))
                at, fill = at + len(part), fill + len(part)
                if fill == self.window:
                    self._write(held)
                    held, fill = [], 0
        if held:
            self._write(held)


def _files(json_path: str | None, ranks_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return str(json_path or public_tokenizers.path("byte_bpe_50k.json")), str(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _batches(made: list[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(made), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[at : at + 20_000], strict=True), kinds, strict=True)], names=names)


def packed(docs: DataFrame, window: int = 2048, end_id: int = 1, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text; others are ignored) in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    A document is its ids and ``end_id``; null and empty texts are that id alone. Each partition of the input packs for itself, without
    a shuffle, and ids of sequences don't clash between partitions. Rows that repeat a doc_id, or have none, are documents of their own.
    Whole windows of a very long text are handed on at once. An empty table gives an empty result.
    """
    paths = _files(json_path, ranks_path)

    def of(batches):
        import public_tokenizers

        encoder = Encoder(*paths, public_tokenizers.PATTERN)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint32)
        kinds = [pa.int64()] * len(NAMES)
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text")), strict=True):
                packer.add(doc, np.concatenate((ids, end)))
            yield from _batches(packer.taken(), kinds, NAMES)
        packer.finish()
        yield from _batches(packer.taken(), kinds, NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, OUT)


def packed_in_order(docs: DataFrame, part: str, row: str, window: int = 2048, end_id: int = 1, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The pieces of ``docs`` as ``packed`` gives them, with sequences numbered from 0, without gaps, along the order (part, row).

    ``part`` and ``row`` (whole numbers) name columns in whose order each partition's rows already stand, as rows of files stand by file and row
    index; only texts of one unbroken run of rows share windows. So the texts aren't shuffled: a run numbers its sequences itself, and the
    runs' numbers of sequences are summed in their order. There are about as many runs as partitions and files.
    """
    paths = _files(json_path, ranks_path)

    def of(batches):
        import public_tokenizers

        encoder = Encoder(*paths, public_tokenizers.PATTERN)
        end, packer, run, after = np.array([end_id], np.uint32), Packer(window, 0), None, None
        names, kinds = ["part", "row", *NAMES], [pa.int64()] * (2 + len(NAMES))

        def taken():
            return [(*run, *x) for x in packer.taken()] if run else []

        for batch in batches:
            made = []
            for doc, p, r, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("row").to_pylist(), encoder.texts(batch.column("text")), strict=True):
                if (p, r) != after:  # another run begins
                    packer.finish()
                    made += taken()
                    packer, run = Packer(window, 0), (p, r)
                packer.add(doc, np.concatenate((ids, end)))
                after = (p, r + 1)
            yield from _batches(made + taken(), kinds, names)
        packer.finish()
        yield from _batches(taken(), kinds, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(part).cast("long").alias("part"), F.col(row).cast("long").alias("row"))
    pieces = cut(rows.mapInArrow(of, "part long, row long, " + OUT), "pieces")
    runs = pieces.groupBy("part", "row").agg((F.max("sequence_id") + 1).alias("n"))
    upto = F.sum("n").over(W.orderBy("part", "row"))  # a row for each run
    first = runs.select("part", "row", (upto - F.col("n")).alias("first"))
    out = pieces.join(small(cut(first, "runs")), ["part", "row"]).withColumn("sequence_id", F.col("first") + F.col("sequence_id"))
    return out.select(*NAMES)
