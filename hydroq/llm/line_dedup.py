"""Repeated lines across documents: range-partitioned hashes, streamed in order, answered with per-document bitmaps.

Lines are hashed (128 bits) and range-partitioned by (hash, document) with a secondary sort by document, largest first,
and position. One streaming pass sees the first occurrence of each key, which is the one that stays, and emits the places of
the others. A very frequent key spans several partitions: what each partition holds of its first and last key (two rows
a partition) is summed up first, so that no partition needs its neighbours' rows.
"""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import LOWER, NO_ID, SPACE, parts_of, partitions, signed, stage, text_rows

LINE_SCHEMA = "h1 long, h2 long, doc long, row long, pos int"
LOW64 = (1 << 64) - 1


def key_of(line):
    return line.strip(SPACE).translate(LOWER)


def hashed_lines(docs, least_chars, id_col="doc_id", text_col="text"):
    """(h1, h2, doc, row, pos): the lines whose key has at least ``least_chars`` code points."""

    def run(batches):
        for batch in parts_of(batches):
            out = [[], [], [], [], []]
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) < least_chars:
                        continue
                    key = key_of(line)
                    if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                        value = xxhash.xxh3_128_intdigest(key)
                        for column, x in zip(out, (signed(value >> 64), signed(value & LOW64), NO_ID if doc is None else doc, row, pos)):
                            column.append(x)
            kinds = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["h1", "h2", "doc", "row", "pos"])

    return text_rows(docs, id_col, text_col).withColumn("row", F.xxhash64("text")).mapInArrow(run, LINE_SCHEMA)


def _columns(batch):
    return [batch.column(k).to_numpy() for k in range(5)]


def _run_ends(batches):
    """The first and the last key of a partition: (h1, h2, documents, largest document)."""
    ends, before = [], None  # ends: [h1, h2, documents, largest]; of more than two the middle ones are dropped
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, _, _ = _columns(batch)
        new_key = np.r_[before is None or (h1[0], h2[0]) != before[:2], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_key | np.r_[before is None or doc[0] != before[2], doc[1:] != doc[:-1]]
        starts = np.flatnonzero(new_key)
        counts = np.add.reduceat(new_doc.astype(np.int64), starts) if len(starts) else []
        lead = int(new_doc[:starts[0] if len(starts) else len(doc)].sum())
        if ends:
            ends[-1][2] += lead
        fresh = [[int(h1[starts[k]]), int(h2[starts[k]]), int(counts[k]), int(doc[starts[k]])] for k in (sorted({0, len(starts) - 1}) if len(starts) else ())]
        if fresh:
            ends = ends[:1] + fresh[-1:] if ends else fresh
        before = (h1[-1], h2[-1], doc[-1])
    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in range(4)], ["h1", "h2", "docs", "top"])


def _later_places(least_docs, spread):
    """Streams a partition; emits (doc, row, pos) of all but the first document of each key found in ``least_docs`` documents.

    spread: totals of the keys that lie in more than one partition. Of an unfinished key at most the rows of
    ``least_docs`` documents and one batch are held.
    """

    def run(batches):
        held, state = None, None  # state: key, largest document and verdict of the key that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch)
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            dropped, held, state = _decide(rows, state, False)
            yield _places(dropped)
        if held is not None:
            yield _places(_decide(held, state, True)[0])

    def _decide(rows, state, last):
        h1, h2, doc, _, _ = rows
        new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(new_key)
        new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
        total, top = np.add.reduceat(new_doc.astype(np.int64), starts), doc[starts].copy()
        known = np.zeros(len(starts), bool)
        for k in sorted({0, len(starts) - 1}):
            key = (int(h1[starts[k]]), int(h2[starts[k]]))
            if key in spread:
                (total[k], top[k]), known[k] = spread[key], True
            elif state is not None and state[0] == key:
                total[k], top[k], known[k] = least_docs, state[1], True
        open_end = not last and not known[-1] and total[-1] < least_docs
        run_of = np.cumsum(new_key) - 1
        gone = (total[run_of] >= least_docs) & (doc != top[run_of])
        if open_end:
            gone[starts[-1]:] = False
        dropped = [x[gone] for x in rows]
        held = [x[starts[-1]:] for x in rows] if open_end else None
        verdict = total[-1] >= least_docs and not last
        return dropped, held, ((int(h1[-1]), int(h2[-1])), top[-1]) if verdict else None

    def _places(rows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows[2:]], ["doc", "row", "pos"])

    return run


def _bitmap(batches):
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            keep = np.ones(max(places) // 8 * 8 + 8, bool)  # whole bytes
            keep[places] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array([len(set(p)) for p in batch.column("places").to_pylist()], pa.int64()), pa.array(maps, pa.binary())], ["doc", "row", "n_dropped", "keep"])


def keep_bitmaps(docs, least_chars=40, least_docs=5, id_col="doc_id", text_col="text"):
    """(doc, row, n_dropped, keep) for the documents that lose lines.

    keep: zlib-compressed bits, lowest first, one for each line up to the last dropped one; 1 means the line stays, as all later
    lines do. doc is the id (NO_ID for null, which counts as the smallest id and as one document), row a hash of the text.
    Repeated rows of one id are one document. Null or empty text: one empty line, never dropped.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    # written first: range bounds are drawn from it and checkpoint() computes twice, which would hash the texts three times
    lines = stage(hashed_lines(docs, least_chars, id_col, text_col), "lines")
    lines = lines.repartitionByRange(n, "h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "row", "pos").checkpoint()
    spread = defaultdict(lambda: [0, NO_ID, 0])
    for h1, h2, count, top in lines.mapInArrow(_run_ends, "h1 long, h2 long, docs long, top long").collect():  # two rows a partition
        seen = spread[h1, h2]
        spread[h1, h2] = [seen[0] + count, max(seen[1], top), seen[2] + 1]
    spread = {key: (count, top) for key, (count, top, parts) in spread.items() if parts > 1}
    places = lines.mapInArrow(_later_places(least_docs, spread), "doc long, row long, pos int")
    return places.groupBy("doc", "row").agg(F.collect_set("pos").alias("places")).mapInArrow(_bitmap, "doc long, row long, n_dropped long, keep binary")


def kept_lines(text, keep):
    """The lines of ``text`` that stay, joined again, and how many went."""
    if keep is None:
        return text, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:len(lines)]
    stay = [line for line, bit in zip(lines, bits.tolist()) if bit] + lines[len(bits):]
    return b"\n".join(stay), len(lines) - len(stay)


def with_bitmaps(docs, bitmaps, id_col="doc_id", text_col="text"):
    """``docs`` with the columns __text (bytes) and __keep; a row meets its bitmap by its id and the hash of its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own = docs.withColumn("__text", text).withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__row", F.xxhash64("__text"))
    marks = stage(bitmaps, "bitmaps").select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("keep").alias("__keep"))
    return own.join(marks, ["__doc", "__row"], "left")


def line_report(docs, least_chars=40, least_docs=5, id_col="doc_id", text_col="text"):
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row; see keep_bitmaps."""

    def run(batches):
        for batch in parts_of(batches):
            lines, dropped, digest = [], [], []
            for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
                kept, gone = kept_lines(text, keep)
                lines.append(text.count(b"\n") + 1)
                dropped.append(gone)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = with_bitmaps(text_rows(docs, id_col, text_col), keep_bitmaps(docs, least_chars, least_docs, id_col, text_col), text_col="text")
    return rows.select("doc_id", F.col("__text").alias("text"), F.col("__keep").alias("keep")).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs, least_chars=40, least_docs=5, id_col="doc_id", text_col="text"):
    """``docs`` with the repeated lines taken out of the text; all rows and columns stay, null text stays null."""

    def run(batches):
        for batch in parts_of(batches):
            texts = []
            for text, keep in zip(batch.column("__text").to_pylist(), batch.column("__keep").to_pylist()):
                texts.append(kept_lines(text, keep)[0].decode("utf-8", "replace") if keep else None)
            own = [c for c in batch.schema.names if c not in ("__text", "__keep")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(texts, pa.string())], [*own, "__new"])

    rows = with_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs, id_col, text_col), id_col, text_col).drop("__doc", "__row")
    rows = rows.withColumn("__text", F.when(F.col("__keep").isNotNull(), F.col("__text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    new = rows.mapInArrow(run, f"{fields}, `__new` string")
    return new.withColumn(text_col, F.coalesce("__new", text_col)).select(*(F.col(f"`{c}`") for c in docs.columns))


@query(
    "op2_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), gone AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM (SELECT k.doc_id, k.pos, k.line, g.key IS NULL OR g.top = k.doc_id AS stays FROM keyed k LEFT JOIN gone g ON k.key = g.key)
GROUP BY doc_id
""",
)
def op2(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))
