"""Near-duplicate texts by 64-bit fingerprints, compared at the anchors of a covering code.

The 64 bits are cut into ``blocks`` parts. Fingerprints at ``bits`` or fewer differing bits differ by at most
``bits // blocks`` in one part at least. In each part the anchors are the words of a Hamming code on its lower
2^r - 1 bits times all values of the other bits; every value lies within one bit of an anchor (covering radius 1).
A fingerprint has its nearest anchor as its home, and is replicated to every anchor within 1 + bits // blocks; two
that are close in the part thus meet at the home of either, and no link is lost.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.cells import blocks_of, in_blocks, local_roots, pairs_of
from hydroq.llm.common import LOWER, parts_of, stage, text_rows
from hydroq.llm.components import components

SEED = 42
DOCS_AT_ONCE = 1 << 18


def shingle_hashes(text, width):
    """XXH64 of every run of ``width`` words; of the whole sequence when there are fewer; none without words."""
    words = text.translate(LOWER).split()
    flat = b" ".join(words)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    start, end = np.r_[0, ends[:n - width]].tolist(), (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(start, end)), np.uint64, n - width + 1)


def fingerprint_of(text, width=4):
    """Bit b is 1 if it is set in over half of the hashes; 0 without words."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), DOCS_AT_ONCE):
        part = hashes[at:at + DOCS_AT_ONCE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs, width=4, id_col="doc_id", text_col="text"):
    """(doc_id, fingerprint: long) for every row."""

    def run(batches):
        for batch in parts_of(batches):
            values = np.fromiter((fingerprint_of(t, width) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def covering(width, reach):
    """Parity columns of the bits and, for each syndrome, the flips of at most ``reach`` bits that lead to an anchor (home first)."""
    r = (width + 1).bit_length() - 1
    column = np.r_[np.arange(1, 2 ** r), np.zeros(width - 2 ** r + 1, int)]
    flips = [[] for _ in range(2 ** r)]
    for size in range(reach + 1):
        for bits in combinations(range(width), size):
            syndrome = 0
            for b in bits:
                syndrome ^= int(column[b])
            flips[syndrome].append(sum(1 << b for b in bits))
    return column, flips


def anchors_of(values, bits, blocks):
    """For fingerprints (uint64): row numbers, cells (part and anchor) and whether the cell is the home."""
    rows, cells, homes = [], [], []
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        column, flips = covering(high - low, 1 + bits // blocks)
        part = (values >> np.uint64(low)).astype(np.int64) & ((1 << (high - low)) - 1)
        syndrome = np.zeros(len(part), np.int64)
        for b, c in enumerate(column):
            syndrome ^= ((part >> b) & 1) * int(c)
        for s, masks in enumerate(flips):
            own = np.flatnonzero(syndrome == s)
            rows.append(np.repeat(own, len(masks)))
            cells.append(((part[own][:, None] ^ np.array(masks, np.int64)).ravel() << 4) | k)
            homes.append(np.tile(np.arange(len(masks)) == 0, len(own)))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def links(prints, bits=4, blocks=3):
    """Links (a, b) between nodes that join all of ``prints`` (node, fingerprint) at ``bits`` or fewer differing bits into the same components.

    Within a block of an anchor the links found are reduced to one per fingerprint before they leave the task.
    """
    names = ["cell", "node", "primary", "fingerprint"]

    def replicate(batches):
        for batch in batches:
            values = batch.column("fingerprint").to_numpy()
            rows, cells, homes = anchors_of(values.view(np.uint64), bits, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column("node").take(pa.array(rows)), pa.array(homes), batch.column("fingerprint").take(pa.array(rows))], names)

    def compare(batches):
        for block in blocks_of(batches):
            node, value = block["node"].to_numpy(), block["fingerprint"].to_numpy()
            left, right = [], []
            for i, j in pairs_of(block):
                near = np.bitwise_count((value[i] ^ value[j]).view(np.uint64)) <= bits
                left.append(i[near])
                right.append(j[near])
            if left:
                root = local_roots(len(node), np.concatenate(left), np.concatenate(right))
                own = np.flatnonzero(root != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])

    met = in_blocks(prints.select("node", "fingerprint").mapInArrow(replicate, "cell long, node long, primary boolean, fingerprint long"), "anchors")
    return met.mapInArrow(compare, "a long, b long")


def _named(rows, prints, edges):
    """``rows`` (doc_id, node, ...: written) with component_id, the smallest doc_id reachable over ``edges`` of ``prints`` (node, first_id)."""
    roots = components(edges).withColumnRenamed("node", "linked")
    rooted = prints.join(roots, prints.node == roots.linked, "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node")


def near_duplicates(docs, bits=4, blocks=3, width=4, id_col="doc_id", text_col="text"):
    """(doc_id, fingerprint: 16 hex digits, component_id) for every row.

    component_id is the smallest doc_id reachable over links of ``bits`` or fewer differing bits. Null, empty and
    blank texts have fingerprint zero and link like any other; repeated rows share a fingerprint and so a component.
    Rows without doc_id get the smallest other id of their component (null if there is none). Empty table: no rows.
    Equal fingerprints are counted once (map-side combine) before anything is compared.
    """
    rows = stage(fingerprints(docs, width, id_col, text_col).withColumn("node", F.col("fingerprint")), "fingerprints")
    prints = stage(rows.groupBy("node", "fingerprint").agg(F.min("doc_id").alias("first_id")), "prints")
    out = _named(rows, prints, links(prints, bits, blocks))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs, bits=4, blocks=3, width=4):
    """The rows of ``docs`` without near copies: of each component the row(s) of the smallest doc_id stay, and rows without id."""
    gone = near_duplicates(docs, bits, blocks, width).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


@query("op8_simhash_dedup")
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
