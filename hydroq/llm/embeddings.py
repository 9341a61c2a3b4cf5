"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A vector is rotated by rounds of random signs and the Walsh-Hadamard transform; the hash is the coordinate of largest
magnitude with its sign, out of 2 d values. ``code`` rotations together make a bucket; ``tables`` of them are
independent. A vector has one home bucket in each table and is also placed in the ``probes`` next likely ones;
it is compared with the vectors placed in its home. Every pair found is verified by its cosine in double precision.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.cells import blocks_of, in_blocks, local_roots, pairs_of
from hydroq.llm.common import signed, stage
from hydroq.llm.components import components

ROUNDS = 3
SEED = 20_240_611


def hadamard(x):
    """The Walsh-Hadamard transform of the rows of ``x``; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def unit_rows(vectors):
    """Rows scaled to length 1 and filled up with zeros to a power of two; the scale is taken out first, so that nothing overflows."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def cells_of(x, tables, code, probes):
    """Cells of unit rows, shape (rows, tables, 1 + probes); the home cell comes first.

    Probes change one hash of the bucket, or several, to its second best value, those that lose least first.
    """
    n, d = x.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, d])
        value, loss = np.empty((n, code, 2), np.int64), np.empty((n, code))
        for c in range(code):
            y = x
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            best = size.argmax(1)
            rows = np.arange(n)
            first = size[rows, best].copy()
            size[rows, best] = -1
            second = size.argmax(1)
            loss[:, c] = first - size[rows, second]
            for k, at in enumerate((best, second)):
                value[:, c, k] = 2 * at + (y[rows, at] < 0)
        changes = np.array(list(itertools.product((0, 1), repeat=code)))  # home first
        order = (loss @ changes.T).argsort(1, kind="stable")[:, :1 + probes]
        order = np.where(np.arange(order.shape[1]) == 0, 0, order)
        picked = np.zeros((n, order.shape[1]), np.int64) + t + 1
        for c in range(code):
            picked = picked * (2 * d + 1) + value[:, c][np.arange(n)[:, None], changes[order, c]]
        picked = picked * 1_000_003 + d
        out[:, t, :picked.shape[1]] = picked
        out[:, t, picked.shape[1]:] = picked[:, :1]
    return out


def code_length(n, d, per_bucket=4):
    """Hashes in a bucket code, so that about ``per_bucket`` of ``n`` unrelated vectors share a bucket."""
    return max(1, math.ceil(math.log(max(2, n / per_bucket)) / math.log(max(4, 2 * d))))


def distinct_vectors(rows, id_col="vec_id", vector_col="embedding"):
    """(vec_id, node, vec) for every row: vec holds the components as bytes, null for vectors that cannot link; equal vectors share the node."""

    def run(batches):
        for batch in batches:
            nodes, vectors = [], []
            for value in batch.column("vector"):
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if value.is_valid else np.empty(0)
                fit = len(x) and np.isfinite(x).all() and x.any()
                raw = packed(x) if fit else None
                vectors.append(raw)
                nodes.append(signed(xxhash.xxh3_64_intdigest(raw)) if fit else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "node", "vec"])

    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.mapInArrow(run, "vec_id long, node long, vec binary")


def packed(x):
    """A vector as bytes: single precision where that is exact, told by the first byte."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return b"f" + short.tobytes() if (short == x).all() else b"d" + x.tobytes()


def _by_length(raw):
    """Row numbers and matrix for each vector length."""
    kinds = np.array([(len(v) - 1) // (4 if v[:1] == b"f" else 8) for v in raw])
    for size in np.unique(kinds):
        own = np.flatnonzero(kinds == size)
        yield own, np.stack([np.frombuffer(raw[k], np.float32 if raw[k][:1] == b"f" else np.float64, offset=1).astype(np.float64) for k in own])


def linked(vectors, least, tables, probes, per_bucket=4):
    """(node, other, weight): links for components (other), and for each node the copies behind its links (weight).

    vectors: (node, vec, copies), one row for each different vector. A pair found in several buckets counts
    where it is met first, which either side can tell from the two vectors alone.
    """
    n = vectors.count()

    def code_for(d):
        return code_length(n, d)

    def place(batches):
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            for own, matrix in _by_length(raw) if raw else ():
                x = unit_rows(matrix)
                cells = cells_of(x, tables, code_for(x.shape[1]), probes)
                flat = cells.reshape(len(own), -1)
                home = np.tile(np.arange(1 + probes) == 0, tables)
                fresh = np.ones(flat.shape, bool)  # a code too short for so many probes repeats its home
                for k in range(1, flat.shape[1]):
                    fresh[:, k] = home[k] | (flat[:, [k]] != flat[:, :k]).all(1)
                rows, slots = np.nonzero(fresh)
                at = own[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[rows, slots]), pa.array(node[at]), pa.array(home[slots]), pa.array(copies[at]), pa.array([raw[k] for k in at], pa.binary())],
                    ["cell", "node", "primary", "copies", "vec"])

    def compare(batches):
        for block in blocks_of(batches):
            cell, node, copies = (block[k].to_numpy() for k in ("cell", "node", "copies"))
            raw = block["vec"].to_pylist()
            for own, matrix in _by_length(raw):
                # vectors of another length never share a cell on purpose, and never link
                x = unit_rows(matrix)
                back = np.full(len(raw), -1)
                back[own] = np.arange(len(own))
                left, right, counted = [], [], []
                for i, j in pairs_of(block):
                    fit = (back[i] >= 0) & (back[j] >= 0) & (node[i] != node[j])
                    i, j = i[fit], j[fit]
                    near = np.concatenate([np.einsum("ij,ij->i", x[back[i[s:s + 65536]]], x[back[j[s:s + 65536]]]) >= least for s in range(0, len(i), 65536)] or [np.empty(0, bool)])
                    i, j = i[near], j[near]
                    left.append(i)
                    right.append(j)
                if not left:
                    continue
                i, j = np.concatenate(left), np.concatenate(right)
                if not len(i):
                    continue
                involved = np.unique(np.r_[i, j])
                codes = np.zeros((len(raw), tables, 1 + probes), np.int64)
                codes[involved] = cells_of(x[back[involved]], tables, code_for(x.shape[1]), probes)
                for s in range(0, len(i), 65536):
                    counted.append(_met_first(codes, cell, node, i[s:s + 65536], j[s:s + 65536]))
                first = np.concatenate(counted)
                weight = np.bincount(i[first], copies[j[first]], len(raw)) + np.bincount(j[first], copies[i[first]], len(raw))
                root = local_roots(len(raw), i, j)
                out = np.flatnonzero((weight > 0) | (root != np.arange(len(raw))))
                yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[root[out]]), pa.array(weight[out].astype(np.int64))], ["node", "other", "weight"])

    placed = vectors.mapInArrow(place, "cell long, node long, primary boolean, copies long, vec binary")
    return in_blocks(placed, "buckets", 512).mapInArrow(compare, "node long, other long, weight long")


def _met_first(codes, cell, node, i, j):
    """Whether the pairs (home row i, placed row j) meet here for the first time, over all tables and both directions."""
    low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
    meets = []
    for home, placed in ((low, high), (high, low)):
        meets.append((codes[home][:, :, :1] == codes[placed]).any(2))
    both = np.stack(meets, axis=2).reshape(len(i), -1)  # by table, then direction
    at_table = (codes[i][:, :, 0] == cell[i][:, None]).argmax(1)
    here = 2 * at_table + (node[i] > node[j])
    return both.argmax(1) == here


def near_vectors(rows, least=0.95, tables=8, probes=3, id_col="vec_id", vector_col="embedding"):
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link at cosine ``least`` or more. Null, empty, zero or non-finite vectors (null components count as
    such) and vectors of another length link with nothing. Equal vectors link with each other and are compared once, with their
    number as weight. Repeated ids count as vectors of their own. Rows without id get the smallest other id of their
    component as component_id, and kept false. Empty table: no rows.
    """
    own = stage(distinct_vectors(rows, id_col, vector_col), "vectors")
    distinct = own.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    distinct = stage(distinct, "distinct")
    shown = own.where("node is not null").select("node", "vec").dropDuplicates(["node"]).join(distinct.select("node", "copies"), "node")
    found = stage(linked(stage(shown, "shown"), least, tables, probes), "links")
    weight = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("root", "top")
    rooted = distinct.join(roots, "node", "left").join(weight, "node", "left").select("node", "copies", "first_id", F.coalesce("top", "node").alias("top"), F.coalesce("weight", F.lit(0)).alias("weight"))
    rooted = stage(rooted, "rooted")
    named = rooted.join(rooted.groupBy("top").agg(F.min("first_id").alias("component")), "top")
    named = named.select("node", "component", (F.col("weight") + F.col("copies") - 1).alias("n_links"))
    out = own.drop("vec").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


@query(
    "op5_embedding_near_dedup",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a
), least AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON node = vec_id LEFT JOIN degree ON a = vec_id
""",
)
def op5(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
