"""Sampled piece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut at each space, which goes with the characters up to the next one; pieces that
hold a space elsewhere than in front aren't used, so no piece crosses a cut. Each such unit has
a lattice: positions are nodes, pieces of the vocabulary that match are edges. Forward filtering sums the probability of all ways to reach
each node; backward sampling walks from the end and draws each edge by its share. The draws
are hashes of the row's key, the unit's place and the step, so a row is always cut alike.

The vocabulary is a public BPE model, which has ranks but no probabilities: a piece of rank r
gets a probability proportional to 1 / (r + 2), and ``alpha`` sharpens or flattens it.
Characters that aren't in the vocabulary are written as their UTF-8 bytes. Spaces are spaces
in pieces, the visible mark for spaces occurring in a text is bytes; so decoding gives back
every text byte by byte.

Defined cases: null stays null both ways; an empty text has the piece of the leading space
only; very long texts are worked on alone; keys can be null or repeat (equal keys with equal
texts give equal pieces). Columns besides key and text are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.llm import text as tx
from kinmatch.llm.shared import fresh

#: Edges and units of the lattices that a task remembers (some 12 and 200 bytes each).
REMEMBERED_EDGES = 2_000_000
REMEMBERED_UNITS = 40_000
#: Bytes of text that are cut at once.
CHUNK_BYTES = 1 << 18
#: Pieces that are decoded at once.
DECODED_PIECES = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a model file as arrays; read once on the driver and sent to the tasks."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = {i: model.id_to_piece(i).replace("▁", " ") for i in usable}
        texts = {i: x for i, x in texts.items() if x and " " not in x[1:]}
        by_bytes = {i: x.encode() for i, x in texts.items()}
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                by_bytes[i] = bytes([value])
        rank = np.array([-model.get_score(i) if i in texts else size for i in range(size)])
        share = 1.0 / (rank + 2.0)
        chosen = np.array(sorted(by_bytes))
        self.log_share = alpha * np.log(share / share[chosen].sum())
        self.log_byte = float(self.log_share[self.byte_ids[0]])
        pieces = [by_bytes.get(i, b"") for i in range(size)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        found: dict[int, int] = {}
        for i, x in texts.items():
            value = 0
            for k, c in enumerate(x):
                value = (value * int(_FACTOR) + ord(c) + 1) & (2**64 - 1)
                found.setdefault(value, -1)
            if found[value] < 0:
                found[value] = i
        self.longest = max(map(len, texts.values()))
        # Every beginning of a piece by its hash, in a table of slots with a few tries each.
        keys = np.array(list(found), np.uint64)
        values = np.array(list(found.values()), np.int32)
        self.bits = max(8, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -2, np.int32)
        self.tries = 0
        left = np.arange(len(keys))
        while len(left):
            slot = self.slot(keys[left], self.tries)
            free = self.values[slot] == -2
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            placed = first[free[first]]
            self.slots[slot[placed]], self.values[slot[placed]] = keys[left[placed]], values[left[placed]]
            left = np.delete(left, placed)
            self.tries += 1

    def slot(self, keys: np.ndarray, attempt: int) -> np.ndarray:
        odd = np.uint64((0xD6E8FEB86659FD93 + 2 * attempt * 0x632BE59BD9B4E019) & (2**64 - 1))
        return ((keys * odd) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for a mere beginning of pieces, -2 if neither."""
        slot = self.slot(keys, 0)
        out = np.where(self.slots[slot] == keys, self.values[slot], -2)
        left = np.flatnonzero((out == -2) & (self.values[slot] != -2))
        for attempt in range(1, self.tries):
            if not len(left):
                break
            slot = self.slot(keys[left], attempt)
            hit = self.slots[slot] == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit & (self.values[slot] != -2)]
        return out


class Growing:
    """An array that is appended to in place."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            larger = np.empty(max(2 * len(self.data), self.size + len(more)), self.data.dtype)
            larger[: self.size] = self.data[: self.size]
            self.data = larger
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)


class Lattices:
    """Filtered lattices of the units met so far.

    Per unit its lowest node and its end; per node the first of its incoming edges; per edge
    its piece (or -1 - character), the node it comes from and the running share among its
    node's edges.
    """

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self) -> None:
        owner = self
        self.new: list[str] = []

        class Known(dict):
            def __missing__(self, unit: str) -> int:
                number = self[unit] = len(self)
                owner.new.append(unit)
                return number

        self.known = Known()
        self.low, self.end, self.first = (Growing(np.int32) for _ in range(3))
        self.piece, self.source, self.share = Growing(np.int32), Growing(np.int32), Growing(np.float32)

    def extend(self) -> None:
        """Filter the lattices of new units, all at once."""
        words = self.words
        if not self.new:
            return
        sizes = np.fromiter(map(len, self.new), np.int64, len(self.new)) + 1
        text = " " + " ".join(self.new)
        self.new = []
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        room = ends[unit] - np.arange(len(codes))
        # Edges by length, as long as what starts at a position begins any piece. A node of a
        # position comes one later for each unit before it, since units have an end node.
        node = np.arange(len(codes)) + unit
        count = len(codes) + len(sizes)
        at, value = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found = []
        degree = np.zeros(count + 1, np.int64)
        for n in range(1, words.longest + 1):
            value = value * _FACTOR + codes[at + n - 1] + np.uint64(1)
            got = words.find(value)
            if n == 1:
                piece, take = np.where(got >= 0, got, -1 - codes.astype(np.int64)), slice(None)
            else:
                piece, take = got, np.flatnonzero(got >= 0)
            source = node[at[take]]
            degree[source + n + 1] += 1
            found.append((n, source, piece[take].astype(np.int32)))
            go = np.flatnonzero((got > -2) & (room[at] > n))
            at, value = at[go], value[go]
            if not len(at):
                break
        first = np.cumsum(degree)
        cursor = first[:-1].copy()
        source, piece = np.empty(first[-1], np.int64), np.empty(first[-1], np.int32)
        for n, start, what in found:
            into = cursor[start + n]
            cursor[start + n] += 1
            source[into], piece[into] = start, what
        weight = words.log_share[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        char = -1 - piece[odd].astype(np.int64)
        weight[odd] = words.log_byte * (1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))
        low = ends - sizes + np.arange(len(sizes))
        depth = np.arange(count) - np.repeat(low, sizes + 1)
        total, share = np.zeros(count), np.empty(len(source), np.float32)
        by_depth = np.argsort(depth.astype(np.uint16) if len(codes) < 1 << 16 or depth.max() < 1 << 16 else depth, kind="stable")
        cuts = np.cumsum(np.bincount(depth))
        for a, b in zip(cuts, cuts[1:]):
            nodes = by_depth[a:b]
            counts = first[nodes + 1] - first[nodes]
            offsets = np.cumsum(counts) - counts
            edges = np.repeat(first[nodes] - offsets, counts) + np.arange(offsets[-1] + counts[-1])
            reach = total[source[edges]] + weight[edges]
            top = np.maximum.reduceat(reach, offsets)
            mass = np.exp(reach - np.repeat(top, counts))
            whole = np.add.reduceat(mass, offsets)
            total[nodes] = top + np.log(whole)
            running = np.cumsum(mass)
            running -= np.repeat(running[offsets] - mass[offsets], counts)
            running /= np.repeat(whole, counts)
            running[offsets + counts - 1] = 2.0
            share[edges] = running
        base = self.first.size
        self.low.add(base + low)
        self.end.add(base + low + sizes)
        self.first.add(self.piece.size + first[:-1])
        self.source.add(base + source)
        self.piece.add(piece)
        self.share.add(share)

    def sample(self, units: np.ndarray, seeds: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units in order, and the number of each unit's pieces."""
        first, piece, source, share = (x.data for x in (self.first, self.piece, self.source, self.share))
        alive, node, lowest = np.arange(len(units)), self.end.data[units], self.low.data[units]
        counts = np.zeros(len(units), np.int64)
        key = tx.mixed(seeds ^ tx.mixed(place.astype(np.uint64) + np.uint64(1)))
        got: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            draw = ((key >> np.uint64(40)).astype(np.float32)) * np.float32(2.0**-24)
            edge = first[node]
            late = np.flatnonzero(share[edge] <= draw)
            while len(late):
                edge[late] += 1
                late = late[share[edge[late]] <= draw[late]]
            got.append((alive, piece[edge]))
            node = source[edge]
            go = np.flatnonzero(node > lowest)
            done = np.ones(len(alive), bool)
            done[go] = False
            counts[alive[done]] = len(got)
            alive, node, lowest = alive[go], node[go], lowest[go]
            key = tx.mixed(key[go] + _FACTOR)
        stops = np.cumsum(counts)
        out = np.empty(int(stops[-1]) if len(stops) else 0, np.int32)
        for step, (which, what) in enumerate(got):
            out[stops[which] - 1 - step] = what
        return out, counts


def with_bytes(pieces: np.ndarray, counts: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Write out characters that are no pieces as the pieces of their bytes."""
    odd = np.flatnonzero(pieces < 0)
    if not len(odd):
        return pieces, counts
    chars = -1 - pieces[odd]
    plain = chars < 128
    pieces[odd[plain]] = words.byte_ids[chars[plain]]
    odd, chars = odd[~plain], chars[~plain]
    if not len(odd):
        return pieces, counts
    spelled = [words.byte_ids[list(chr(p).encode("utf-8", "surrogatepass"))] for p in chars.tolist()]
    width = np.ones(len(pieces), np.int64)
    width[odd] = [len(x) for x in spelled]
    out = np.repeat(pieces, width)
    starts = np.cumsum(width) - width
    into = np.repeat(starts[odd], width[odd]) + np.concatenate([np.arange(len(x)) for x in spelled])
    out[into] = np.concatenate(spelled)
    owner = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(owner, width, minlength=len(counts)).astype(np.int64)


def encoded(
    documents: DataFrame, words: Vocabulary, key_col="doc_id", text_col="text", pieces_col="pieces", seed=0,
    lossless_col: str | None = None,
) -> DataFrame:
    """The table with a column of sampled piece ids; a column of that name is replaced.

    With ``lossless_col`` the pieces are decoded again in the same task, and that column says
    whether they give back the text byte by byte.
    """
    hash_col = fresh(documents, "_seed")
    added = {pieces_col: T.ArrayType(T.IntegerType(), False)} | ({lossless_col: T.BooleanType()} if lossless_col else {})
    names = [c for c in documents.columns if c.lower() not in {n.lower() for n in added}]
    at = names.index(text_col)
    rows = documents.select(*names, F.xxhash64(F.lit(seed), key_col).alias(hash_col))
    schema = T.StructType([*documents.select(names).schema, *(T.StructField(n, t) for n, t in added.items())])
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        lattices = Lattices(words)
        for batch in batches:
            for part in tx.chunks(batch, at, CHUNK_BYTES):
                if len(lattices.known) > REMEMBERED_UNITS or lattices.piece.size > REMEMBERED_EDGES:
                    lattices.clear()
                units = pc.split_pattern(pc.fill_null(part.column(at), ""), " ")
                sizes = units.value_lengths().to_numpy()
                units = units.flatten().dictionary_encode()
                number = np.fromiter(map(lattices.known.__getitem__, units.dictionary.to_pylist()), np.int64, len(units.dictionary))
                found = number[units.indices.to_numpy()]
                lattices.extend()
                seeds = np.repeat(part.column(len(names)).to_numpy().astype(np.uint64), sizes)
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                pieces, counts = lattices.sample(found, seeds, place)
                pieces, counts = with_bytes(pieces, counts, words)
                stops = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
                null = part.column(at).is_null()
                columns = [pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(pieces), mask=null)]
                if lossless_col:
                    columns.append(same_texts(part.column(at), texts_in_parts(columns[0], words)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *columns], [*names, *added])

    return rows.mapInArrow(lambda batches: tx.tidied(encode(batches)), schema)


def decoded_texts(pieces: pa.Array, words: Vocabulary) -> pa.Array:
    """Texts of a column of piece ids; the leading space of the encoding goes."""
    flat = pieces.flatten().to_numpy()
    sizes = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    lengths = words.lengths[flat]
    stops = np.cumsum(lengths)
    index = np.repeat(words.starts[flat] - (stops - lengths), lengths) + np.arange(stops[-1] if len(stops) else 0)
    data = words.blob[index].tobytes()
    bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(sizes)])]
    valid = pieces.is_valid().to_pylist()
    return pa.array([data[a + 1 : b].decode() if ok else None for a, b, ok in zip(bounds, bounds[1:], valid)], pa.string())


def texts_in_parts(pieces: pa.Array, words: Vocabulary) -> pa.Array:
    """``decoded_texts`` of so many rows at once as stay within ``DECODED_PIECES``."""
    stops = np.cumsum(pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [pa.array([], pa.string())], 0
    while at < len(pieces):
        before = stops[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(stops, before + DECODED_PIECES, "right")))
        out.append(decoded_texts(pieces.slice(at, to - at), words))
        at = to
    return pa.concat_arrays(out)


def same_texts(given: pa.Array, back: pa.Array) -> pa.Array:
    """Whether two columns hold the same texts, null as null."""
    both_null = pc.and_(given.is_null(), back.is_null())
    return pc.or_(both_null, pc.fill_null(pc.equal(given, back.cast(given.type)), False))


def decoded(rows: DataFrame, words: Vocabulary, pieces_col="pieces", text_col="text") -> DataFrame:
    """The table with the texts that its piece ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("string")
    def text_of(pieces: pa.Array) -> pa.Array:
        return texts_in_parts(pieces, shared.value)

    return rows.withColumn(text_col, text_of(pieces_col))
