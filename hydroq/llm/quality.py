"""Text quality without labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Each labeller looks at one simple measure of a text and votes good, bad or not at all. Votes of all documents are counted by pattern (at
most 3 to the number of labellers), and a two-class model with independent labellers is fitted to these counts: the E
step gives each pattern its chance of being good, the M step each labeller its accuracies. The chances label documents
for a logistic scorer over hashed words and measures, which then judges every text.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import parts_of, partitions, stage

BUCKETS = 1 << 16
ABSTAIN, BAD, GOOD = 0, 1, 2
MEASURES = ("words", "mean_word", "symbols", "digits", "upper", "distinct", "top_word", "repeated_lines", "bars", "ends", "marked")
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]+")
DIGITS = re.compile(r"\d+")
UPPERS = re.compile(r"[A-Z]+")
LETTERS = re.compile(r"[^\W\d_]+")
END = re.compile(r"[.!?:\"')]\s*$")

# Measure, bounds of a bad vote (low, high), bounds of a good vote (low, high).
LABELLERS = [
    ("words", (-1, 1), (20, 1e12)),
    ("mean_word", (14, 1e12), (3, 9)),
    ("symbols", (0.06, 2), (-1, 0.02)),
    ("digits", (0.2, 2), (-1, 0.06)),
    ("upper", (0.4, 2), (0.002, 0.15)),
    ("distinct", (-1, 0.4), (0.7, 10)),
    ("top_word", (0.3, 2), (-1, 0.15)),
    ("repeated_lines", (0.4, 2), (-1, 0.15)),
    ("bars", (0.1, 2), (-1, 0.01)),
    ("ends", (-1, 0.2), (0.6, 2)),
    ("marked", (0.25, 2), (-1, 0.1)),
]


def _size(runs, text):
    return sum(map(len, runs.findall(text)))


def measures_of(text):
    """The MEASURES of a text."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    letters = max(1, _size(LETTERS, text))
    symbols = _size(SYMBOLS, text)
    return (
        n, (sum(map(len, words)) / n) if n else 0.0, symbols / size, _size(DIGITS, text) / size, _size(UPPERS, text) / letters,
        len(counts) / max(1, n) ** 0.8, (max(counts.values(), default=1) - 1) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)),
        sum(counts[x] for x in ("|", "||", "»", "•")) / max(1, n), sum(1 for x in lines if END.search(x)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if SYMBOLS.search(w)) / max(1, n) if symbols else 0.0,
    )


def votes_of(values):
    """Votes (rows, labellers) from measures (rows, MEASURES); a text without words is bad by all that can say so."""
    votes = np.zeros((len(values), len(LABELLERS)), np.int64)
    for k, (name, bad, good) in enumerate(LABELLERS):
        x = values[:, MEASURES.index(name)]
        votes[:, k] = np.where((x > bad[0]) & (x <= bad[1]), BAD, np.where((x > good[0]) & (x <= good[1]), GOOD, ABSTAIN))
    return votes


def pattern_of(votes):
    return votes @ (3 ** np.arange(votes.shape[1]))


def fit(patterns, counts, rounds=60):
    """Chance of good of each pattern, the share of good, and the chances of each vote by class and labeller.

    patterns: numbers of vote patterns; counts: documents with each. Starts from good for the patterns without a bad vote.
    """
    votes = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    one_hot = votes[:, :, None] == np.arange(3)
    good = np.where((votes == BAD).any(1), 0.1, 0.9)
    for _ in range(rounds):
        share, log_chance = np.empty(2), []
        for k, belief in enumerate((1 - good, good)):
            weight = belief * counts
            share[k] = weight.sum() + 1
            table = np.einsum("p,plv->lv", weight, one_hot) + 0.5
            log_chance.append(np.log(table / table.sum(1, keepdims=True)))
        prior = np.log(share / share.sum())
        score = [prior[k] + np.einsum("plv,lv->p", one_hot, log_chance[k]) for k in range(2)]
        good = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
    return good, share[1] / share.sum(), np.exp(np.array(log_chance))


def features_of(texts, values):
    """Hashed words (by share of the text, square root) and measures (in steps): row numbers, buckets, weights."""
    lists = [t.split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    rows, buckets, weights = [], [], []
    if counts.sum():
        codes, words = pd.factorize(np.array([w for x in lists for w in x], object))
        hashed = (pd.util.hash_array(np.asarray(words, object), categorize=False) >> np.uint64(40)).astype(np.int64) % BUCKETS
        row = np.repeat(np.arange(len(texts)), counts)
        cells, times = np.unique(row * BUCKETS + hashed[codes], return_counts=True)
        rows.append(cells // BUCKETS)
        buckets.append(cells % BUCKETS)
        weights.append(np.sqrt(times / counts[cells // BUCKETS]))
    for k in range(values.shape[1]):
        x = values[:, k]
        step = np.minimum(30, np.floor(4 * np.log2(1 + x)) if x.max(initial=0) > 2 else np.floor(30 * np.minimum(1, x))).astype(np.int64)
        rows.append(np.arange(len(texts)))
        buckets.append((7919 * (k + 1) + step * 104_729) % BUCKETS)
        weights.append(np.full(len(texts), 0.5))
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(weights)


def _values(texts):
    return np.array([measures_of(t) for t in texts], float).reshape(len(texts), len(MEASURES))


def weak_labels(docs, text_col="text"):
    """The fitted chance of good by vote pattern, as a dict (at most 3 to the number of labellers), over all rows."""

    def run(batches):
        for batch in batches:
            patterns, counts = np.unique(pattern_of(votes_of(_values(batch.column("text").to_pylist()))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(counts.astype(np.int64))], ["pattern", "n"])

    own = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = own.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return {}
    counted = counted.sort_values("pattern")
    good, _, _ = fit(counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(float))
    return dict(zip(counted["pattern"].tolist(), good.tolist()))


def train(docs, belief, train_docs=20_000, rounds=25, rate=0.7, id_col="doc_id", text_col="text"):
    """Weights of the scorer (BUCKETS and a bias), from about ``train_docs`` rows picked by a hash of id and text.

    Full gradient steps with a rate for each weight (Adagrad); a round adds up one vector of BUCKETS numbers a task.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("mark"))
    share = min(1.0, train_docs / max(1, docs.count()))

    def vectors(batches):
        for batch in parts_of(batches, 1000):
            texts = batch.column("text").to_pylist()
            values = _values(texts)
            label = np.array([belief.get(p, 0.5) for p in pattern_of(votes_of(values)).tolist()])
            row, bucket, weight = features_of(texts, values)
            order = np.argsort(row, kind="stable")
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(label), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket[order].astype(np.int32))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(weight[order].astype(np.float32)))],
                ["label", "bucket", "weight"])

    picked = rows.where(F.pmod("mark", F.lit(1 << 20)) < round(share * (1 << 20))).select("text")
    picked = stage(picked.mapInArrow(vectors, "label double, bucket array<int>, weight array<float>"), "quality").coalesce(min(16, partitions(docs.sparkSession)))
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):

        def gradient(batches, weights=weights.copy()):
            total, n = np.zeros(BUCKETS + 1), 0
            for batch in batches:
                buckets, values = batch.column("bucket"), batch.column("weight")
                sizes = np.diff(buckets.offsets.to_numpy())
                at, x = buckets.flatten().to_numpy(), values.flatten().to_numpy().astype(float)
                row = np.repeat(np.arange(batch.num_rows), sizes)
                score = np.bincount(row, x * weights[at], batch.num_rows) + weights[-1]
                error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - batch.column("label").to_numpy()
                total[:-1] += np.bincount(at, x * error[row], BUCKETS)
                total[-1] += error.sum()
                n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["total", "n"])

        parts = picked.mapInArrow(gradient, "total binary, n long").collect()
        n = sum(p["n"] for p in parts)
        if not n:
            break
        slope = sum(np.frombuffer(p["total"]) for p in parts) / n + 1e-6 * weights
        seen += slope ** 2
        weights -= rate * slope / np.sqrt(seen)
    return weights


def judge(docs, belief, weights, least=0.5, id_col="doc_id", text_col="text"):
    """(doc_id, votes_good, votes_bad, weak_label, score, keep) for every row; null text counts as empty.

    weak_label: chance of good by the votes alone. score: that of the linear scorer, keep: score of at least ``least``.
    Texts without words get score 0. Repeated rows are judged alike; other columns stay out. Empty table: no rows.
    """

    def run(batches):
        for batch in parts_of(batches, 1000):
            texts = batch.column("text").to_pylist()
            values = _values(texts)
            votes = votes_of(values)
            row, bucket, weight = features_of(texts, values)
            raw = np.bincount(row, weight * weights[bucket], len(texts)) + weights[-1]
            score = np.where(values[:, 0] > 0, 1 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0)
            label = [belief.get(p, 0.5) for p in pattern_of(votes).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array((votes == GOOD).sum(1).astype(np.int64)), pa.array((votes == BAD).sum(1).astype(np.int64)), pa.array(label, pa.float64()), pa.array(score), pa.array(score >= least)],
                ["doc_id", "votes_good", "votes_bad", "weak_label", "score", "keep"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, votes_good long, votes_bad long, weak_label double, score double, keep boolean")


def classify(docs, train_docs=20_000, least=0.5, id_col="doc_id", text_col="text"):
    """The three steps one after the other; see judge."""
    belief = weak_labels(docs, text_col)
    return judge(docs, belief, train(docs, belief, train_docs, id_col=id_col, text_col=text_col), least, id_col, text_col)


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"))
