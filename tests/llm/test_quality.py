import numpy as np

from hydroq.llm import quality


def test_em_recovers_accuracies():
    rng = np.random.default_rng(5)
    n, k = 60_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.7
    votes = np.zeros((n, k), int)
    for j in range(k):
        right = rng.random(n) < 0.9
        votes[:, j] = np.where(rng.random(n) < 0.2, quality.ABSTAIN, np.where(right == good, quality.GOOD, quality.BAD))
    patterns, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    belief, share, chances = quality.fit(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.02
    assert np.abs(chances[1, :, quality.GOOD] - 0.72).max() < 0.03 and np.abs(chances[0, :, quality.BAD] - 0.72).max() < 0.03
    table = dict(zip(patterns.tolist(), belief.tolist()))
    assert np.mean([(table[p] > 0.5) == g for p, g in zip(quality.pattern_of(votes).tolist(), good)]) > 0.97


def test_against_labels(spark):
    """The labels of the table are seen by the test only."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality.classify(docs).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    good = [r.keep for r in found if r.quality == 1]
    bad = [r.keep for r in found if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "A clean short text, with words and an end."), (4, "A clean short text, with words and an end."), (None, "### $$$ %%%"), (5, "one. " * 50_000)]
    docs = docs_of(rows).withColumnRenamed("lang", "score")
    got = quality.classify(docs).collect()
    assert len(got) == len(rows)
    assert all(r.score == 0 and not r.keep for r in got if r.doc_id in (1, 2, 3))
    assert len({(r.score, r.keep) for r in got if r.doc_id == 4}) == 1
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0)).count() == 0
