"""Sampled segmentation over the piece lattice, and its lossless inverse.

The vocabulary of a SentencePiece model gives the lattice: every way to write a text as pieces, a character without a
piece as its UTF-8 bytes. A piece of rank r weighs 1 / (r + 1) to the power ``sharpness``. Forward filtering sums the
weights of all ways to reach each place; backward sampling then draws the last piece, the one before it and so on,
each from its exact distribution. The draws are numbers of the row key and the place, so a row always gets the same
segmentation. No piece crosses a line end or starts inside a word and ends in the next, so the lattice falls into units (spaces with the word
after them) that are filtered once for each different unit of a batch.
"""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import parts_of, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = re.compile(r" *[^ \n]+| +|\n")
SPACE_MARK = 0x2581
BYTE_SYMBOL = 0x200000
MIX = np.uint64(0x9E3779B97F4A7C15)
CHARS_AT_ONCE = 1_500_000
UNUSED = -1e8


def vocabulary(path=MODEL):
    """(text, score, byte value or -1) of each piece of a model file; control pieces have no text. Read on the driver: executors need no file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = []
    for k in range(model.get_piece_size()):
        text = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k):
            rows.append((None, 0.0, -1))
        elif model.is_byte(k):
            rows.append((None, 0.0, int(text[1:-1], 16)))
        else:
            rows.append((text, model.get_score(k), -1))
    return rows


def _hash_step(value, symbols):
    value = (value ^ symbols.astype(np.uint64)) * MIX
    return value ^ (value >> np.uint64(31))


class Lattice:
    """Pieces by the hashes of their prefixes, and what decoding needs."""

    def __init__(self, rows, sharpness=1.0):
        self.byte_id = np.full(256, -1)
        self.bytes_of = []
        n = len(rows)
        self.weight = np.full(n, -sharpness * np.log(n + 1.0))
        by_length = {}
        for k, (text, score, byte) in enumerate(rows):
            if byte >= 0:
                self.byte_id[byte] = k
                self.bytes_of.append(bytes([byte]))
            elif text is None:
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(text.replace("▁", " ").encode())
                if score > UNUSED:
                    self.weight[k] = -sharpness * np.log(1.0 - score)
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                value = np.zeros(1, np.uint64)
                for i, p in enumerate(points):
                    value = _hash_step(value, np.array([p]))
                    table = by_length.setdefault(i, {})
                    table.setdefault(int(value[0]), -1)
                table[int(value[0])] = k
        self.tables = []
        for i in sorted(by_length):
            keys = np.array(sorted(by_length[i]), np.uint64)
            self.tables.append((keys, np.array([by_length[i][int(x)] for x in keys])))
        self.single = np.zeros(0x110000, bool)
        for text, _, _ in rows:
            if text is not None and len(text) == 1:
                self.single[ord(text)] = True

    def symbols(self, units):
        """Symbols of all units in a row, and their number by unit: marked characters, or bytes where there is no piece."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        literal_mark = points == SPACE_MARK
        points = np.where(points == 0x20, SPACE_MARK, points)
        missing = np.flatnonzero(~self.single[points] | literal_mark)
        if not len(missing):
            return points, sizes
        encoded = [chr(p).encode() for p in points[missing].tolist()]
        width = np.ones(len(points), np.int64)
        width[missing] = [len(e) for e in encoded]
        out = np.repeat(points, width)
        start = np.cumsum(width) - width
        for s, e in zip(start[missing].tolist(), encoded):
            out[s:s + len(e)] = np.frombuffer(e, np.uint8).astype(np.int64) + BYTE_SYMBOL
        unit = np.repeat(np.arange(len(units)), sizes)
        return out, np.bincount(unit, width, len(units)).astype(np.int64)

    def filtered(self, units):
        """Forward filtering of all units: (last node of each unit, first node, edge keys, start node and piece of the edges).

        The edges into a node are neighbours; the key of an edge is its node and, in the lower 32 bits, the chance of it or one
        before it. Whole numbers keep a draw the same whatever units are filtered together.
        """
        symbols, sizes = self.symbols(units)
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(units)), sizes)
        left = ends[unit] - np.arange(len(symbols))  # symbols up to the end of the unit
        local = sizes[unit] - left
        alive, value = np.arange(len(symbols)), np.zeros(len(symbols), np.uint64)
        raw = symbols >= BYTE_SYMBOL
        at = np.flatnonzero(raw)
        parts = [(at, np.ones(len(at), np.int64), self.byte_id[symbols[at] - BYTE_SYMBOL])]
        alive = np.flatnonzero(~raw)
        value = value[alive]
        for size, (keys, ids) in enumerate(self.tables, 1):
            fits = left[alive] >= size
            alive, value = alive[fits], value[fits]
            if not len(alive):
                break
            value = _hash_step(value, symbols[alive + size - 1])
            k = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            known = keys[k] == value
            alive, value, k = alive[known], value[known], ids[k[known]]
            whole = k >= 0
            parts.append((alive[whole], np.full(whole.sum(), size), k[whole]))
        start, size, piece = (np.concatenate(x) for x in zip(*parts))
        level = local[start] + size
        node = start + unit[start]
        into = node + size
        order = np.argsort((level << 40) | into, kind="stable")
        node, into, piece, level = node[order], into[order], piece[order], level[order]
        weight = self.weight[piece]
        reach = np.zeros(len(symbols) + len(units))
        chance = np.empty(len(node))
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]]).tolist() + [len(level)]
        first_of = np.r_[True, into[1:] != into[:-1]]
        for a, b in zip(cuts, cuts[1:]):
            total = reach[node[a:b]] + weight[a:b]
            heads = np.flatnonzero(first_of[a:b])
            top = np.maximum.reduceat(total, heads)
            counts = np.diff(np.r_[heads, b - a])
            part = np.exp(total - np.repeat(top, counts))
            sums = np.add.reduceat(part, heads)
            reach[into[a:b][heads]] = top + np.log(sums)
            chance[a:b] = part / np.repeat(sums, counts)
        order = np.argsort(into, kind="stable")
        node, into, piece, chance = node[order], into[order], piece[order], chance[order]
        heads = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
        counts = np.diff(np.r_[heads, len(into)])
        upto = chance.copy()
        for k in range(1, int(counts.max(initial=0))):  # edge by edge, so that a sum does not depend on the other nodes
            own = heads[counts > k] + k
            upto[own] += upto[own - 1]
        key = (into << 32) + np.minimum(upto * 2.0 ** 32, 2.0 ** 32).astype(np.int64)
        key[heads + counts - 1] = (into[heads + counts - 1] + 1) << 32
        first = np.cumsum(sizes) - sizes + np.arange(len(units))
        return first + sizes, first, key, node, piece

    def sample(self, texts, seeds):
        """Piece ids (one array) and the number of pieces of each text."""
        lists = [UNIT.findall(t) for t in texts]
        per_text = np.fromiter(map(len, lists), np.int64, len(lists))
        if not per_text.sum():
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        codes, units = pd.factorize(np.array([u for x in lists for u in x], object))
        last, first, key, start, piece = self.filtered(units.tolist())
        n = len(codes)
        text = np.repeat(np.arange(len(texts)), per_text)
        place = np.arange(n) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        with np.errstate(over="ignore"):
            stream = (seeds[text] ^ (place.astype(np.uint64) * MIX))
        active, state, home = np.arange(n), last[codes], first[codes]
        taken, step = [], 0
        while len(active):
            step += 1
            edge = np.searchsorted(key, (state << 32) + _draw(stream[active] + np.uint64(step)), "right")
            taken.append((active, piece[edge].astype(np.int32)))
            state = start[edge]
            more = state > home
            active, state, home = active[more], state[more], home[more]
        counts = np.zeros(n, np.int64)
        for own, _ in taken:
            counts[own] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.int32)
        for back, (own, ids) in enumerate(taken, 1):
            out[ends[own] - back] = ids
        return out, np.bincount(text, counts, len(texts)).astype(np.int64)

    def text_of(self, ids):
        return b"".join([self.bytes_of[k] for k in ids])


def _draw(x):
    """Numbers of 32 bits from counters (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x * MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.int64)


_BUILT = {}


def lattice_of(rows, sharpness):
    """The lattice, built once in each worker."""
    mark = (len(rows), sharpness, hash(tuple(rows[-50:])))
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Lattice(rows, sharpness)
    return _BUILT[mark]


def row_seeds(keys, texts, seed):
    """A seed for each row, from its key; rows without key use their text."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}" if k is not None else f"{seed}/{t}") for k, t in zip(keys, texts)], np.uint64)


def _portions(texts, chars=CHARS_AT_ONCE):
    """Ranges of texts of some ``chars`` characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars or k + 1 == len(texts):
            yield at, k + 1
            at, size = k + 1, 0


def encode(docs, model=MODEL, seed=1, sharpness=1.0, id_col="doc_id", text_col="text", check=None, chars=CHARS_AT_ONCE):
    """``docs`` with the column ``piece_ids``: a segmentation drawn for each row, the same whenever it is drawn again.

    check: name of a further column, whether decoding gives the text again, found in the same pass. chars: characters whose lattices
    are held at once.

    Null text has null piece_ids, empty text none. Rows of one id and one text get one segmentation, rows without id are
    seeded by their text. An existing column piece_ids is replaced. Empty table: no rows.
    """
    rows = vocabulary(model)

    def run(batches):
        lattice = lattice_of(rows, sharpness)
        for batch in parts_of(batches):
            keys, texts = batch.column("__key").to_pylist(), batch.column("__own").to_pylist()
            plain = [t or "" for t in texts]
            own = [c for c in batch.schema.names if c not in ("__key", "__own")]
            for a, b in _portions(plain, chars):
                ids, counts = lattice.sample(plain[a:b], row_seeds(keys[a:b], plain[a:b], seed))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts[a:b]]))
                more = [lists]
                if check:
                    cuts, flat = np.r_[0, np.cumsum(counts)].tolist(), ids.tolist()
                    more.append(pa.array([lattice.text_of(flat[s:e]) == t.encode() for s, e, t in zip(cuts, cuts[1:], plain[a:b])]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in own), *more], [*own, "piece_ids", *([check] if check else [])])

    docs = docs.drop("piece_ids", *([check] if check else []))
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    given = docs.withColumn("__key", F.col(id_col).cast("string")).withColumn("__own", F.col(text_col).cast("string"))
    return given.mapInArrow(run, f"{fields}, piece_ids array<int>" + (f", `{check}` boolean" if check else ""))


def decode(encoded, model=MODEL, ids_col="piece_ids", to="decoded"):
    """``encoded`` with the text of the pieces in column ``to``; null where there are no ids."""
    rows = vocabulary(model)

    def run(batches):
        lattice = lattice_of(rows, 1.0)
        for batch in parts_of(batches, 500):
            column = batch.column(ids_col)
            offsets = column.offsets.to_numpy()
            flat, offsets = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].tolist(), (offsets - offsets[0]).tolist()
            texts = [lattice.text_of(flat[a:b]).decode() if ok else None for a, b, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{to}` string")


def encode_and_check(docs, model=MODEL, seed=1, sharpness=1.0, id_col="doc_id", text_col="text"):
    """(doc_id, n_bytes, n_pieces, piece_ids, decoded_sha256, lossless) for every row; null text counts as empty."""
    rows = vocabulary(model)

    def run(batches):
        lattice = lattice_of(rows, sharpness)
        for batch in parts_of(batches):
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            for a, b in _portions(texts):
                ids, counts = lattice.sample(texts[a:b], row_seeds(keys[a:b], texts[a:b], seed))
                offsets = np.r_[0, np.cumsum(counts)]
                cuts, flat = offsets.tolist(), ids.tolist()
                back = [lattice.text_of(flat[s:e]) for s, e in zip(cuts, cuts[1:])]
                raw = [t.encode() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in raw], pa.int64()), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                     pa.array([hashlib.sha256(t).hexdigest() for t in back]), pa.array([x == y for x, y in zip(raw, back)])],
                    ["doc_id", "n_bytes", "n_pieces", "piece_ids", "decoded_sha256", "lossless"])

    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, piece_ids array<int>, decoded_sha256 string, lossless boolean")


@query("op6_piece_sampling")
def op6(spark, sf_dir):
    return encode_and_check(table(spark, sf_dir, "documents"))
