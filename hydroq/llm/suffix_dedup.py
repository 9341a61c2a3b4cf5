"""Removal of byte strings that also start anywhere else, by column-wise construction over many documents at once.

Comparing all suffixes of a corpus in one place does not scale, and inserting one symbol per document needs as many
rounds as the longest document has bytes. Two steps keep the rounds and the files short without losing a match:

1. Every string of ``length`` bytes has an anchor, its leftmost run of ``GRAM`` bytes with the smallest hash. That
   depends on the string alone, so equal strings have equal anchors at equal places. The strings of a document
   that share an anchor form a piece of fewer than 2 ``length`` bytes; pieces are dealt out by their anchor's hash. Pieces found
   whole more than once, or with an anchor found only once, are settled by counting.
2. The other pieces are written out sorted by anchor; each task streams its file and inserts one symbol per piece each
   round, from the right, all pieces aligned at their anchors. A round is one stable sort by the new symbol of the
   order so far: the new column of the collection's Burrows-Wheeler order, in which the symbols stand before the sorted suffixes. The common
   prefixes of neighbours are updated with it (one more than the minimum between them in the round before). Suffixes
   inserted in other rounds need no comparison, as equal strings start in the same round. Where neighbours share
   ``length`` symbols or more, both strings occur elsewhere.

Anchors shared by more than ``LARGE_GROUP`` different pieces are not gathered: their strings are counted one by one.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import parts_of, partitions, signed, stage, text_rows

LENGTH = 400
GRAM = 64
LARGE_GROUP = 4096
PIECES_AT_ONCE = 8192
SEGMENT = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C15
LOW64 = (1 << 64) - 1
POSITION_BITS = np.uint64(24)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, as many as needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n):
        if len(cls.up) < n:
            n = max(n, 2 * SEGMENT + 2 * LENGTH)
            inverse = pow(MULTIPLIER, -1, 1 << 64)
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n, MULTIPLIER, np.uint64)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)], dtype=np.uint64)
        return cls.up, cls.down


def gram_hashes(data):
    """A hash of the GRAM bytes at each place of ``data`` (uint8)."""
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    value = (sums[GRAM:] - sums[:-GRAM]) * down[:len(data) - GRAM + 1]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value


def window_minima(values, width):
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pieces_in(data, bounds, length):
    """Anchor hash, anchor, first and last string start of the pieces of the documents that lie at ``bounds`` (start, end) of ``data``."""
    values = gram_hashes(data)
    place = np.arange(len(values), dtype=np.uint64)
    low = window_minima((values >> POSITION_BITS << POSITION_BITS) | place, length - GRAM + 1)
    anchor = (low & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    for start, end in bounds:
        if end - start >= length:
            inside[start] += 1
            inside[end - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[:len(anchor)]))
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    own = anchor[starts]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    last = np.r_[first[1:] - 1, len(starts) - 1]
    at = own[first]
    return values[at].view(np.int64), at, starts[first], starts[last]


def _segments(texts, length):
    """Groups of (document number, offset in it, bytes) of about SEGMENT bytes; long texts are cut, each string start lying in one cut."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            part = text[at:at + SEGMENT + length - 1]
            if len(part) >= length:
                group.append((k, at, part))
                size += len(part)
            if size >= SEGMENT:
                yield group
                group, size = [], 0
    if group:
        yield group


def _covered(first, last, length):
    """Byte runs covered by the strings that start at first..last (arrays sorted by first), merged."""
    ends = np.maximum.accumulate(last + length)
    new = np.r_[True, first[1:] > ends[:-1]]
    cut = np.flatnonzero(new)
    return first[cut], ends[np.r_[cut[1:] - 1, len(ends) - 1]]


PIECE_SCHEMA = "h long, a long, b long, doc long, row long, anchor int, first int, last int, copies long"


def find_pieces(rows, length):
    """PIECE_SCHEMA rows of all pieces; (doc, row) without h are byte runs (first, last) already known to occur elsewhere.

    Pieces found whole more than once in a batch leave as one row with their number, which keeps copies small before
    they are shuffled.
    """

    def run(batches):
        for batch in parts_of(batches, 4000):
            doc, row = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            found = {}
            for group in _segments(batch.column("text").to_pylist(), length):
                data = b"".join(part for _, _, part in group)
                ends = np.cumsum([len(part) for _, _, part in group])
                begin = np.r_[0, ends[:-1]]
                h, anchor, first, last = pieces_in(np.frombuffer(data, np.uint8), zip(begin.tolist(), ends.tolist()), length)
                which = np.searchsorted(ends, first, "right")
                for x, at, s, e, w in zip(h.tolist(), anchor.tolist(), first.tolist(), last.tolist(), which.tolist()):
                    k, offset, _ = group[w]
                    digest = xxhash.xxh3_128_intdigest(data[s:e + length], at - s)
                    shift = offset - int(begin[w])
                    found.setdefault((x, digest), []).append((k, at + shift, s + shift, e + shift))
            out, spans = [[] for _ in range(9)], {}
            for (x, digest), places in found.items():
                k, at, s, e = places[0]
                for column, value in zip(out, (x, signed(digest >> 64), signed(digest & LOW64), doc[k], row[k], at, s, e, len(places))):
                    column.append(value)
                if len(places) > 1:
                    for k, _, s, e in places:
                        spans.setdefault(k, []).append((s, e))
            for k, runs in spans.items():
                runs.sort()
                for s, e in zip(*_covered(*np.array(runs).T, length)):
                    for column, value in zip(out, (None, None, None, doc[k], row[k], None, int(s), int(e), 0)):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["h", "a", "b", "doc", "row", "anchor", "first", "last", "copies"])

    return rows.select("doc_id", "row", "text").mapInArrow(run, PIECE_SCHEMA)


def repeated_starts(pieces, length):
    """For (bytes, anchor offset) pieces: a boolean matrix (start relative to the anchor + length - GRAM, piece) of the strings that two pieces share."""
    reach = length - GRAM
    lead = np.array([reach - offset for _, offset in pieces])
    width = int(max(s + len(text) for s, (text, _) in zip(lead, pieces)))
    n = len(pieces)
    columns = np.zeros((width, n), np.uint16)  # 0 stands outside of the piece
    for k, (s, (text, _)) in enumerate(zip(lead.tolist(), pieces)):
        columns[s:s + len(text), k] = np.frombuffer(text, np.uint8)
        columns[s:s + len(text), k] += 1
    marks = np.zeros((reach + 1, n), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.uint16)  # common[t]: of the suffixes at t - 1 and t
    for at in range(width - 1, -1, -1):
        symbols = columns[at][order]
        moved = symbols.argsort(kind="stable")
        ranked = symbols[moved]
        same = np.flatnonzero(ranked[1:] == ranked[:-1])
        fresh = np.zeros(n + 1, np.uint16)
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[0::2], between[1::2] = moved[same] + 1, moved[same + 1] + 1
            fresh[same + 1] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[moved], fresh
        if at <= reach:
            hit = np.flatnonzero(common >= length)
            if len(hit):
                marks[at, order[hit]] = True
                marks[at, order[hit - 1]] = True
    counts = np.array([len(text) - length for text, _ in pieces])
    at = np.arange(reach + 1)[:, None]
    return marks & (at >= lead) & (at <= lead + counts), lead


def _spans(doc, row, first, marks, lead, length):
    """Rows (doc, row, first, last) of the byte runs covered by the marked strings of the pieces."""
    out = [[], [], [], []]
    for k in np.flatnonzero(marks.any(0)):
        starts = np.flatnonzero(marks[:, k]) - lead[k] + first[k]
        for s, e in zip(*_covered(starts, starts, length)):
            for column, value in zip(out, (doc[k], row[k], int(s), int(e))):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["doc", "row", "first", "last"])


SPAN_SCHEMA = "doc long, row long, first int, last int"


def compare_groups(length):
    """Streams pieces sorted by anchor hash, whole groups at a time."""

    def run(batches):
        held, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            n = held.num_rows
            if n < PIECES_AT_ONCE:
                continue
            same = held["h"].to_numpy() == held["h"][-1].as_py()
            whole = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if whole:
                yield from _compared(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _compared(held)

    def _compared(rows):
        h = rows["h"].to_numpy()
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        at = 0
        while at < len(h):  # whole groups, about PIECES_AT_ONCE pieces
            later = starts[starts >= min(at + PIECES_AT_ONCE, len(h))]
            end = int(later[0]) if len(later) else len(h)
            part = rows.slice(at, end - at)
            first = part["first"].to_pylist()
            pieces = list(zip(part["text"].to_pylist(), [x - s for x, s in zip(part["anchor"].to_pylist(), first)]))
            marks, lead = repeated_starts(pieces, length)
            marks[:, part["copies"].to_numpy() > 1] = False  # settled already
            yield _spans(part["doc"].to_pylist(), part["row"].to_pylist(), first, marks, lead, length)
            at = end

    return run


def single_strings(length):
    """Every string of the pieces of a large group: (a, b) hash of the string and its place."""

    def run(batches):
        for batch in batches:
            for text, doc, row, first, copies in zip(*(batch.column(k).to_pylist() for k in ("text", "doc", "row", "first", "copies"))):
                n = len(text) - length + 1
                digests = [xxhash.xxh3_128_intdigest(text[s:s + length]) for s in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([signed(d >> 64) for d in digests], pa.int64()), pa.array([signed(d & LOW64) for d in digests], pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()), pa.array([copies] * n, pa.int64())],
                    ["a", "b", "doc", "row", "first", "copies"])

    return run


def _cut_out(length):
    """The pieces of packed texts."""

    def run(batches):
        for batch in parts_of(batches, 1000):
            out = [[] for _ in range(8)]
            for packed, wanted in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
                text = zstandard.decompress(packed)
                for w in wanted:
                    for column, value in zip(out, (w["h"], w["large"], w["doc"], w["row"], w["anchor"], w["first"], w["copies"], text[w["first"]:w["last"] + length])):
                        column.append(value)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["h", "large", "doc", "row", "anchor", "first", "copies", "text"])

    return run


def _pack(batches):
    packer = zstandard.ZstdCompressor(level=1)
    for batch in parts_of(batches, 1000):
        texts = pa.array([packer.compress(t) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), texts], ["doc_id", "row", "packed"])


def repeated_spans(rows, length=LENGTH):
    """(doc, row, first, last): byte runs of the texts that strings of ``length`` bytes found elsewhere cover; they may overlap.

    rows: (doc_id, row, text: bytes). doc is null for rows without id.
    """
    spark = rows.sparkSession
    pieces = stage(find_pieces(rows, length), "pieces")
    known = pieces.where("h is null").select("doc", "row", "first", "last")
    pieces = pieces.where("h is not null")
    several = pieces.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h")
    again = stage(pieces.join(several, "h", "left_semi"), "again")
    place = F.struct("doc", "row", "anchor", "first", "last")
    kinds = stage(again.groupBy("h", "a", "b").agg(F.sum("copies").alias("copies"), F.min(place).alias("place")), "kinds")
    whole = kinds.where("copies > 1").select("h", "a", "b")
    whole = again.join(whole, ["h", "a", "b"], "left_semi").select("doc", "row", "first", (F.col("last") + length).alias("last"))
    groups = stage(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    wanted = kinds.join(groups, "h").select("h", (F.col("n") > LARGE_GROUP).alias("large"), "copies", "place.*")
    wanted = wanted.groupBy(F.col("doc").alias("own"), F.col("row").alias("own_row")).agg(F.collect_list(F.struct("h", "large", "doc", "row", "anchor", "first", "last", "copies")).alias("wanted"))
    packed = rows.mapInArrow(_pack, "doc_id long, row long, packed binary")
    met = packed.join(wanted, packed.doc_id.eqNullSafe(wanted.own) & (packed.row == wanted.own_row)).select("packed", "wanted")
    texts = stage(met.mapInArrow(_cut_out(length), "h long, large boolean, doc long, row long, anchor int, first int, copies long, text binary"), "texts")
    usual = texts.where("not large").drop("large").repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(compare_groups(length), SPAN_SCHEMA)
    strings = texts.where("large").mapInArrow(single_strings(length), "a long, b long, doc long, row long, first int, copies long")
    twice = strings.groupBy("a", "b").agg(F.sum("copies").alias("n")).where("n > 1").select("a", "b")
    large = strings.join(twice, ["a", "b"], "left_semi").select("doc", "row", "first", (F.col("first") + length).alias("last"))
    return known.unionAll(whole).unionAll(usual).unionAll(large)


def cut(text, spans):
    """What is left of ``text``, the number of removed bytes and of maximal removed runs."""
    if not spans:
        return text, 0, 0
    spans = sorted((s["first"], s["last"]) for s in spans)
    runs = [list(spans[0])]
    for s, e in spans[1:]:
        if s > runs[-1][1]:
            runs.append([s, e])
        else:
            runs[-1][1] = max(runs[-1][1], e)
    kept, at = [], 0
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), len(runs)


def without_repeats(docs, length=LENGTH, id_col="doc_id", text_col="text"):
    """(doc_id, n_bytes, n_removed, n_spans, kept: bytes) for every row.

    Null text counts as empty; texts shorter than ``length`` lose nothing. Repeated rows are documents of their own, so
    both lose what they share. Rows without id are handled like any other. Empty table: no rows. Other columns stay out.
    """

    def run(batches):
        for batch in parts_of(batches, 1000):
            done = [cut(zstandard.decompress(t), s) for t, s in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist())]
            sizes = [len(left) + gone for left, gone, _ in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([x[0] for x in done], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = text_rows(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    spans = repeated_spans(rows, length).groupBy("doc", F.col("row").alias("own_row")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = stage(spans, "spans")
    packed = rows.mapInArrow(_pack, "doc_id long, row long, packed binary")
    met = packed.join(spans, packed.doc_id.eqNullSafe(spans.doc) & (packed.row == spans.own_row), "left").select("doc_id", "packed", "spans")
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@query(
    "op1_suffix_array_dedup",
    r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, md5(b[p:p + 399]) AS m FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, p, p + 400 AS e, lag(p + 400) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w SEMI JOIN again USING (m)),
runs AS (SELECT doc_id, min(p) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit) GROUP BY doc_id, run),
edges AS (SELECT doc_id, s, e, coalesce(lag(e) OVER o, 1) AS open_at FROM runs WINDOW o AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT d.doc_id, octet_length(b) + 1, octet_length(b) + 1, coalesce(max(e), 1) FROM d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id, b)
SELECT doc_id, octet_length(any_value(b)) AS n_bytes, (octet_length(any_value(b)) - sum(s - open_at))::BIGINT AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(CASE WHEN s > open_at THEN hex(b[open_at:s - 1]) ELSE '' END, '' ORDER BY s))) AS kept_sha256
FROM edges JOIN d USING (doc_id) GROUP BY doc_id
""",
)
def op1(spark, sf_dir):
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
