"""Packing token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import sliced

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"

_ENCODERS: dict[str, WordEncoder] = {}


# How the word vocabulary file prepares texts. Only for files that do so are texts taken word by word.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The letters that byte-level vocabularies write for bytes: visible ones are themselves, the others follow from 256 on.
_VISIBLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
LETTER_OF_BYTE = {b: 0x100 + n for n, b in enumerate(sorted(set(range(0x100)) - set(_VISIBLE)))}

#: Characters on whose class, case and normal form all Unicode versions agree and that never compose with a neighbour:
#: printable ASCII, letters and marks of two Latin blocks, and common punctuation.
SURE = {*range(0x21, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2028), 0x20AC} - {0xAD, 0x130, 0x149}


class WordEncoder(dict):
    """Little-endian uint32 ids of a word without blanks, memoised by word and by the pieces into which the
    vocabulary's pattern splits it. Both memos are emptied when they reach ``limit`` entries.

    A word of SURE characters only is split here; any other word goes to the tokenizer as it is, so its own Unicode
    tables decide. A file that prepares texts in another way than NORMALIZER and PATTERN gets whole texts.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        plan = json.loads(self.tokenizer.to_str())
        steps = (plan["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (
            plan["normalizer"] == NORMALIZER
            and plan["post_processor"] is None
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
        )
        self.marks = [t["content"] for t in plan["added_tokens"]]
        self.split = regex.compile(PATTERN).findall
        self.unsure = re.compile("[^ \n" + re.escape("".join(map(chr, sorted(SURE)))) + "]").search
        self.pieces: dict[str, bytes] = {}
        self.limit = limit

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def modelled(self, piece: str) -> bytes:
        """The ids of a piece from the model itself, which reads bytes as letters."""
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(LETTER_OF_BYTE)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(spelt)])

    def __missing__(self, word: str) -> bytes:
        if self.unsure(word):
            out = self.direct(word)
        else:
            out = b""
            for piece in self.split(word.lower()):
                got = self.pieces.get(piece)
                if got is None:
                    if len(self.pieces) >= self.limit:
                        self.pieces.clear()
                    got = self.pieces[piece] = self.modelled(piece)
                out += got
        if len(self) >= self.limit:
            self.clear()
        if len(word) < 40:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids the tokenizer gives for the whole text, as bytes."""
        if not self.by_word or any(m in text for m in self.marks):
            return self.direct(text)
        if not self.unsure(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp k-way largest differencing: the window (0..k-1) of each size.

    A partial partition is a descending vector of k sums. The two with the widest spread merge,
    largest sums against smallest, until one is left; ties go by age. Windows are then traced back.
    """
    n = len(sizes)
    heap: list[tuple[int, int]] = []
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    for t, i in enumerate(np.argsort(-sizes, kind="stable")):
        v = np.zeros(k, dtype=np.int64)
        v[0] = sizes[i]
        sums[int(i)] = v
        heap.append((-int(sizes[i]) if k > 1 else 0, int(i)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        v = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        new = n + len(merges)
        merges.append((a, b, order))
        sums[new] = v
        heapq.heappush(heap, (int(v[-1] - v[0]), new))
    windows = np.zeros(n, dtype=np.int64)
    slots = {n + len(merges) - 1 if merges else 0: np.arange(k)}
    for j in range(len(merges) - 1, -1, -1):
        a, b, order = merges[j]
        before = np.empty(k, dtype=np.int64)
        before[order] = slots.pop(n + j)
        slots[a], slots[b] = before, before[::-1]
    for i, s in slots.items():
        windows[i] = s[0]
    return windows


def windows_for(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows by differencing; the count starts at the least that could do and rises while any window
    is over capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        got = differencing(sizes, k)
        over = np.bincount(got, weights=sizes, minlength=k).max() if len(sizes) else 0
        if over <= capacity:
            return got, k
        k += max(1, int(k * (over - capacity) / capacity / 3))


def cuts(n: int, capacity: int, small: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows first, the rest in near-equal pieces of at
    most ``small``."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    rest = n % capacity
    parts = -(-rest // small)
    at = n - rest
    for p in range(parts):
        size = (rest * (p + 1)) // parts - (rest * p) // parts
        out.append((at, size))
        at += size
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    small: int = 512,
    block_windows: int = 64,
    end_id: int = 1,
) -> DataFrame:
    """Pack all rows of docs (doc_id, text) into sequences of at most ``capacity`` ids.

    A document is its ids and then ``end_id``; null text is empty text, so every row has at least one
    piece. Full windows of long documents are sequences of their own. Other pieces gather, as a task
    reads its rows, in blocks of ``block_windows`` windows, and each block is divided by differencing.
    No row is shuffled; a task holds one block at a time. Sequence ids carry the partition number in
    their upper 31 bits, so they are unique without a count over all tasks. A last block that cannot
    fill its windows leaves under one window of padding per task. Null doc_ids and repeated rows are
    packed as they are; other columns are ignored; empty in, empty out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        made = 0
        done: list[list] = []
        waiting: list[list] = []
        load = 0

        def flush() -> None:
            nonlocal made, load
            if waiting:
                sizes = np.array([p[2] for p in waiting], dtype=np.int64)
                got, k = windows_for(sizes, capacity)
                filled = np.bincount(got, weights=sizes, minlength=k).astype(np.int64)
                number = np.cumsum(filled > 0) - 1
                offset = np.zeros(k, dtype=np.int64)
                for piece, w in zip(waiting, got.tolist(), strict=True):
                    full = int(filled[w])
                    done.append([*piece, base + made + int(number[w]), int(offset[w]), 0 if full & (full - 1) == 0 else capacity - full])
                    offset[w] += piece[2]
                made += int(number[-1]) + 1
                waiting.clear()
                load = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"],
            )

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + tail
                n = len(ids) // 4
                for start, size in cuts(n, capacity, small):
                    piece = [doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n]
                    if size == capacity:
                        done.append([*piece, base + made, 0, 0])
                        made += 1
                    else:
                        waiting.append(piece)
                        load += size
                        if load >= block_windows * capacity - small:
                            flush()
            if done:
                yield out()
        flush()
        if done:
            yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)
