"""SentencePiece encoding as a best path, with giant texts cut and joined by a max-plus scan.

A text's merging (BPE) segmentation is the one path through the lattice of pieces in which no two neighbours would
have been merged otherwise: each neighbouring pair, encoded on its own, is that pair again. So a pair of neighbours
weighs 0 if that holds and minus infinity if not, and exactly one path of a text weighs 0. Max-plus algebra over these
two weights is kept as sets: a transfer matrix holds the pairs of boundary states that a path of weight 0 connects.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, sliced

SPACE = "▁"
_VOCABULARIES: dict[str, Vocabulary] = {}

State = tuple[int, str]  # at a cut: characters since the last piece ended, and that piece ("" at a text's start)
START = (0, "")


class Memo(dict):
    """A cache of find(key) in two generations of ``size`` keys: what is asked for again outlives the older one."""

    def __init__(self, find: Callable[[str], bytes], size: int):
        super().__init__()
        self.find, self.size, self.older = find, size, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.find(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        if len(key) < 40:
            self[key] = got
        return got


class Vocabulary:
    """Pieces of a SentencePiece file of the BPE kind, and its segmentations by paths over them.

    Files of other kinds, with own normalisation or with user-defined pieces are refused.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if (
            spec.model_type != 2 or not spec.byte_fallback or spec.treat_whitespace_as_suffix or norm.precompiled_charsmap
            or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not kinds <= {1, 2, 3, 6}
        ):
            raise ValueError("only BPE files with byte fallback and without normalisation are supported")
        self.names = [p.piece for p in model.pieces]
        self.bytes = [b""] * 256
        self.byte_of: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        self.id: dict[str, bytes] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_of[i] = int(p.piece[3:5], 16)
                self.bytes[int(p.piece[3:5], 16)] = i.to_bytes(4, "little")
            elif p.type == 1:
                self.rank[p.piece] = p.score
                self.id[p.piece] = i.to_bytes(4, "little")
        self.longest = max(map(len, self.rank))
        self.halo = 2 * self.longest  # what a chunk must know of the text before it
        self.inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(x[1] == SPACE != x[0] for x in self.inside):
            raise ValueError("pieces that hold a blank after another character are not supported")
        line = "" if any("\n" in x for x in self.inside) else "\n"
        self.units = re.compile(rf"{line}|{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" if line else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        # A trie: each node holds whether it is a piece, and its children.
        self.trie: dict[str, list] = {}
        for p in self.rank:
            at: dict[str, list] = self.trie
            for c in p:
                node = at.setdefault(c, [False, {}])
                at = node[1]
            node[0] = True
        spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.names)]
        self.spelling = pa.array(spelt, pa.large_binary())
        self.memo = Memo(self.unit_ids, limit)
        # Whether two neighbours weigh 0; of "" and a piece, whether merging leaves that piece.
        self.pair = Memo(lambda x: self.merge(x[0] + x[1]) == [y for y in x if y], limit)

    # Paths

    def merge(self, text: str) -> list[str]:
        """Merging as defined: of neighbours that make up a piece the best ranked, from the left, until there are none."""
        parts, get = list(text), self.rank.get
        worst = -np.inf
        while True:
            top = worst
            for i in range(len(parts) - 1):
                v = get(parts[i] + parts[i + 1])
                if v is not None and v > top:
                    top, at = v, i
            if top == worst:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def forward(self, text: str, before: str = "") -> list[str | None]:
        """For each place after the start the last piece of the path of weight 0 that ends there, None if there is none.
        ``before`` is the piece in front of the text. A path's pieces are those of merging its stretch, so there is
        one path at most."""
        n, trie, pair = len(text), self.trie, self.pair
        last: list[str | None] = [before] + [None] * n
        for s in range(n):
            if (prev := last[s]) is None:
                continue
            at, e = trie, s
            while e < n and (node := at.get(text[e])):
                known, at = node
                e += 1
                if known and pair[prev, text[s:e]]:
                    last[e] = text[s:e]
            if text[s] not in self.rank and pair[prev, text[s]]:
                last[s + 1] = text[s]
        return last

    def path(self, text: str) -> list[str]:
        """The path of weight 0 through a whole stretch, longer pieces tried first. A place that leads nowhere is left for
        good: only one piece can end there."""
        n, trie, pair, rank = len(text), self.trie, self.pair, self.rank
        out: list[str] = []
        others: list[list[int]] = []  # for each piece taken: where else it might end
        dead: set[int] = set()
        s, prev = 0, ""
        while s < n:
            at, e, ends = trie, s, []
            if text[s] not in rank:
                ends.append(s + 1)
            while e < n and (node := at.get(text[e])):
                known, at = node
                e += 1
                if known:
                    ends.append(e)
            while True:
                while ends:
                    e = ends.pop()
                    if e not in dead and pair[prev, text[s:e]]:
                        break
                else:  # nothing leads on from here: the piece before ends elsewhere
                    dead.add(s)
                    s -= len(out.pop())
                    prev, ends = (out[-1] if out else ""), others.pop()
                    continue
                break
            prev = text[s:e]
            out.append(prev)
            others.append(ends)
            s = e
        return out

    def piece_ids(self, pieces: list[str]) -> bytes:
        """The ids of pieces as little-endian uint32; an unknown character has those of its bytes."""
        get = self.id.get
        return b"".join(get(p) or b"".join(self.bytes[b] for b in p.encode("utf-8", "replace")) for p in pieces)

    def ids(self, last: list[str | None], end: int) -> bytes:
        """The ids of the path that :func:`forward` found to ``end``."""
        out: list[str] = []
        while end > 0:
            out.append(last[end])
            end -= len(out[-1])
        return self.piece_ids(out[::-1])

    def unit_ids(self, text: str) -> bytes:
        """The ids of a stretch between places that no piece can span."""
        return self.piece_ids(self.path(text))

    def stretch(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.units(text)))

    def encode(self, text: str) -> bytes:
        return self.stretch(marked(text)) if text else b""

    def decode(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.names[i].replace(SPACE, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    # Chunks of giant texts. ``halo`` characters before the chunk are given along.

    def hard(self, text: str, halo: int) -> list[int]:
        """The first place in the chunk that no piece can span, and the last one that is not among its last
        ``longest`` characters; none if there are no such two (which may be one). What stands before such a place does
        not matter behind it."""
        stop = len(text) - self.longest
        first = next((p for p in range(halo + 1, stop + 1) if text[p - 1 : p + 1] not in self.inside), None)
        if first is None:
            return []
        return [first, next(p for p in range(stop, first - 1, -1) if text[p - 1 : p + 1] not in self.inside)]

    def starts(self, text: str, halo: int) -> list[State]:
        """The states that the cut after ``halo`` characters may have: START before a text's first character, else each
        piece or unknown character that ends fewer than ``longest`` characters before the cut."""
        if not halo:
            return [START]
        ends = range(max(0, halo - self.longest) + 1, halo + 1)
        return [(halo - e, text[s:e]) for e in ends for s in range(max(0, e - self.longest), e) if text[s:e] in self.rank or s == e - 1]

    def sweep(self, text: str, halo: int, states: list[State]) -> list[dict[str, int]]:
        """For each place: the last pieces of paths of weight 0, each with a bit for every state that leads there.
        The first piece after a state ends behind the cut."""
        n, trie = len(text), self.trie
        alive: list[dict[str, int]] = [{} for _ in range(n + 1)]
        for bit, (s, piece) in enumerate(states):
            own = alive[halo - s]
            own[piece] = own.get(piece, 0) | 1 << bit
        for s in range(max(0, halo - self.longest), n):
            if not alive[s]:
                continue
            at, e, found = trie, s, []
            while e < n and (node := at.get(text[e])):
                known, at = node
                e += 1
                if known:
                    found.append(e)
            if text[s] not in self.rank:
                found.append(s + 1)
            for e in found:
                if e > halo:
                    piece = text[s:e]
                    bits = 0
                    for prev, x in alive[s].items():
                        if self.pair[prev, piece]:
                            bits |= x
                    if bits:
                        alive[e][piece] = alive[e].get(piece, 0) | bits
        return alive

    def transfer(self, text: str, halo: int) -> Transfer:
        """Which states at the chunk's end follow which at its start."""
        n, states = len(text), self.starts(text, halo)
        ends = self.hard(text, halo)
        alive = self.sweep(text[: ends[0]] if ends else text, halo, states)
        if ends:
            bits = 0
            for x in alive[ends[0]].values():
                bits |= x
            into = frozenset(s for i, s in enumerate(states) if bits >> i & 1)
            tail = n - ends[1]
            last = self.forward(text[ends[1] :])
            out = frozenset((tail - e, p) for e, p in enumerate(last) if p is not None and tail - e < self.longest)
            return Transfer(None, into, out)
        table: dict[State, set[State]] = {}
        for e in range(max(0, n - self.longest + 1), n + 1):
            for piece, bits in alive[e].items():
                for i, s in enumerate(states):
                    if bits >> i & 1:
                        table.setdefault(s, set()).add((n - e, piece))
        return Transfer({s: frozenset(x) for s, x in table.items()})

    def emit(self, text: str, halo: int, into: State, out: State) -> bytes:
        """The ids of the chunk's pieces between its two boundary states."""
        begin, end = halo - into[0], len(text) - out[0]
        if end <= halo:
            return b""
        ends = self.hard(text, halo)
        if not ends:
            return self.ids(self.forward(text[begin:end], into[1]), end - begin)
        ids = self.ids(self.forward(text[begin : ends[0]], into[1]), ends[0] - begin)
        return ids + self.stretch(text[ends[0] : ends[1]]) + self.ids(self.forward(text[ends[1] : end]), end - ends[1])


class Transfer:
    """A max-plus matrix of weights 0 and minus infinity between boundary states: ``table`` maps a state to those it
    connects with; if None, all of ``into`` connect with all of ``out`` (a chunk that a hard cut divides)."""

    def __init__(self, table: dict[State, frozenset[State]] | None, into: frozenset[State] = frozenset(), out: frozenset[State] = frozenset()):
        self.table, self.into, self.out = table, into, out

    def ahead(self, states: frozenset[State]) -> frozenset[State]:
        """The states behind the chunk that follow some of ``states``."""
        if self.table is None:
            return self.out if states & self.into else frozenset()
        return frozenset().union(*(self.table.get(s, ()) for s in states))

    def back(self, states: frozenset[State]) -> frozenset[State]:
        """The states before the chunk from which some of ``states`` follow."""
        if self.table is None:
            return self.into if states & self.out else frozenset()
        return frozenset(s for s, x in self.table.items() if x & states)

    def __matmul__(self, other: Transfer) -> Transfer:
        """Product; associative, so chunks may be combined in any grouping."""
        if self.table is None:
            return Transfer(None, self.into, other.ahead(self.out))
        if other.table is None:
            return Transfer(None, self.back(other.into), other.out)
        return Transfer({s: y for s, x in self.table.items() if (y := other.ahead(x))})

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Transfer) and self.pairs() == other.pairs()

    __hash__ = None

    def pairs(self) -> set[tuple[State, State]]:
        rows = {s: self.out for s in self.into} if self.table is None else self.table
        return {(s, x) for s, out in rows.items() for x in out}


def marked(text: str) -> str:
    """A text as its pieces see it: blanks are marks, and one stands before all."""
    return SPACE + text.replace(" ", SPACE)


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _bytes_column(parts: list[bytes]) -> pa.Array:
    values = np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) // 4 for p in parts)]), pa.int32()), pa.array(values))


def _product(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of chunks as one: the product of their matrices in order."""
    rows = rows.sort_values("chunk")
    whole = None
    for m in rows["m"]:
        whole = pickle.loads(m) if whole is None else whole @ pickle.loads(m)
    return pd.DataFrame({"uid": rows["uid"].iloc[:1], "chunk": rows["block"].iloc[:1], "m": [pickle.dumps(whole)]})


def _root(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For whole texts: START, and the states in which a piece ends where the text does."""
    for df in frames:
        ends = [frozenset(x for x in pickle.loads(m).ahead(frozenset({START})) if not x[0]) for m in df["m"]]
        yield pd.DataFrame({"uid": df["uid"], "block": df["chunk"], "states": [pickle.dumps((frozenset({START}), e)) for e in ends]})


def _spread(rows: pd.DataFrame) -> pd.DataFrame:
    """From the states at the start and the end of a block, those at the start and the end of each of its chunks."""
    rows = rows.sort_values("chunk")
    matrices = [pickle.loads(m) for m in rows["m"]]
    before, after = pickle.loads(rows["states"].iloc[0])
    starts, ends = [before], [after]
    for m in matrices[:-1]:
        starts.append(m.ahead(starts[-1]))
    for m in reversed(matrices[1:]):
        ends.append(m.back(ends[-1]))
    both = [pickle.dumps((s & m.back(e), e & m.ahead(s))) for s, m, e in zip(starts, matrices, reversed(ends), strict=True)]
    return pd.DataFrame({"uid": rows["uid"], "chunk": rows["chunk"], "states": both})


def encode_documents(docs: DataFrame, model_path: str, chunk: int = 32_768, fan: int = 64, digests: bool = False) -> DataFrame:
    """(doc_id, chunk, ids), or (doc_id, chunk, *DIGESTS) if only ``digests`` of the ids are wanted, for every row of docs (doc_id, text): the ids of the SentencePiece file's own library, in
    pieces of text of about ``chunk`` characters, numbered from 0.

    Texts up to ``chunk`` characters are encoded whole where they are. A longer one is cut every ``chunk``
    characters wherever that falls. Each part yields its transfer matrix between boundary states; matrices are
    multiplied in blocks of ``fan``, level by level, so that no task gathers a whole text; possible states go
    down the same tree from a text's start and from its end, and leave one state for each cut; then parts trace
    their ids on their own. So the result is that of one pass over the text, whatever the cuts. Equal giant texts are
    encoded once. Null and empty texts give one row with no ids. Repeated rows stay; other columns are ignored; empty
    in, empty out.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        for batch in sliced(batches):
            ids = [voc.encode(t or "") for t in batch.column(1).to_pylist()]
            yield told(voc, batch.column(0), pa.array(np.zeros(batch.num_rows, np.int32)), ids, "doc_id")

    def told(voc: Vocabulary, key: pa.Array, number: pa.Array, parts: list[bytes], name: str) -> pa.RecordBatch:
        ids = _bytes_column(parts)
        columns = _digests(voc, number.to_pylist(), ids) if digests else [ids]
        return pa.RecordBatch.from_arrays([key, number, *columns], names=[name, "chunk", *outputs])

    outputs = list(DIGESTS) if digests else ["ids"]
    schema = ", ".join(f"{c} long" for c in DIGESTS) if digests else "ids array<int>"
    small = rows.where(~giant).mapInArrow(direct, f"doc_id {kind}, chunk int, {schema}")

    big = rows.where(giant).withColumn("uid", F.sha2("text", 256))
    whole = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    halo = vocabulary(model_path).halo
    if chunk < halo:
        raise ValueError(f"a chunk must hold at least {halo} characters")
    parts = (
        big.groupBy("uid").agg(F.first("text").alias("text"))
        .select("uid", whole.alias("text"))
        .select("uid", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / chunk).cast("int") - 1)).alias("chunk"))
        .withColumn("halo", F.least(F.lit(halo), F.col("chunk") * chunk))
        .select("uid", "chunk", "halo", F.substr("text", F.col("chunk") * chunk - F.col("halo") + 1, F.col("halo") + chunk).alias("text"))
    )
    parts = materialize(parts.repartition("uid", "chunk"))
    most = parts.agg(F.max("chunk")).first()[0]
    if most is None:
        return small

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        for batch in sliced(batches, 32):
            got = [pickle.dumps(voc.transfer(t, h)) for t, h in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], names=["uid", "chunk", "m"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        for batch in sliced(batches, 32):
            got = []
            for text, before, states in zip(*(batch.column(k).to_pylist() for k in (3, 2, 4)), strict=True):
                (into,), (out,) = pickle.loads(states)  # one path, so one state at each cut
                got.append(voc.emit(text, before, into, out))
            yield told(voc, batch.column(0), batch.column(1), got, "uid")

    block = F.floor(F.col("chunk") / fan).cast("int").alias("block")
    tree = [materialize(parts.select("uid", "chunk", "halo", "text").mapInArrow(matrices, "uid string, chunk int, m binary"))]
    while most:
        above = tree[-1].withColumn("block", block).groupBy("uid", "block").applyInPandas(_product, "uid string, chunk int, m binary")
        tree.append(materialize(above))
        most //= fan
    states = tree[-1].mapInPandas(_root, "uid string, block int, states binary")
    for level in reversed(tree[:-1]):
        known = level.withColumn("block", block).join(states, ["uid", "block"])
        states = materialize(known.groupBy("uid", "block").applyInPandas(_spread, "uid string, chunk int, states binary"))
        states = states.withColumnRenamed("chunk", "block") if level is not tree[0] else states
    for level in tree:
        discard(level)
    encoded = parts.join(states, ["uid", "chunk"]).select("uid", "chunk", "halo", "text", "states").mapInArrow(emit, f"uid string, chunk int, {schema}")
    return small.unionByName(big.select("doc_id", "uid").join(encoded, "uid").select("doc_id", "chunk", *outputs))


DIGESTS = ("n_ids", "ids_crc32", "decoded_bytes", "decoded_crc32")


def _digests(voc: Vocabulary, chunks: list[int], ids: pa.Array) -> list[pa.Array]:
    """DIGESTS of lists of ids: their number and crc32 (little-endian uint32), and length and crc32 of the text they spell
    (UTF-8); the blank put before each text is taken off chunk 0."""
    offsets, own = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten()
    values, spelt = own.to_numpy(), voc.spelling.take(own)
    at = np.frombuffer(spelt.buffers()[1], dtype=np.int64)[offsets].tolist()
    whole, out = memoryview(spelt.buffers()[2] or b""), []
    for k, chunk in enumerate(chunks):
        mine = values[offsets[k] : offsets[k + 1]]
        text = whole[at[k] : at[k + 1]][1 if chunk == 0 else 0 :]
        out.append((len(mine), zlib.crc32(mine.astype("<u4").tobytes()), len(text), zlib.crc32(text)))
    return [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]


def piece_digests(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, chunk) and DIGESTS of encode_documents' rows; encode_documents itself gives them too, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(model_path)
        for batch in sliced(batches):
            columns = _digests(voc, batch.column(1).to_pylist(), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "chunk", *DIGESTS])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "chunk", "ids").mapInArrow(run, f"doc_id {kind}, chunk int, " + ", ".join(f"{c} long" for c in DIGESTS))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from rows (doc_id, chunk, ids): the inverse of encode_documents; one row for each
    doc_id. Null ids decode to the empty text. A document's chunks meet in one task; repeated rows of a chunk count once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(model_path)
        for df in frames:
            got = [voc.decode(list(x) if x is not None else []) for x in df["ids"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "chunk": df["chunk"], "part": got})

    parts = encoded.dropDuplicates(["doc_id", "chunk"]).mapInPandas(run, "doc_id long, chunk int, part string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("doc_id").agg(whole.alias("text")).select("doc_id", F.substr("text", F.lit(2)).alias("text"))
