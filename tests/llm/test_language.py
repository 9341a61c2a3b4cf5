import itertools

import numpy as np
import pytest

from hydroq.llm import language


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32) * 2
    got = language.viterbi(scores, counts, 1.5)
    at = 0
    for n in counts:
        own = scores[at:at + n].astype(float)
        value = lambda p: sum(own[k, x] for k, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        if n:
            assert abs(value(got[at:at + n].tolist()) - max(value(p) for p in itertools.product(range(3), repeat=int(n)))) < 1e-4
        at += n


def test_scripts():
    assert [int(language.script_of(np.array([ord(c)]))[0]) for c in "aéΩяא漢あア한ｱ"] == [0, 0, 1, 2, 4, 18, 16, 17, 14, 17]


@pytest.fixture(scope="module")
def learned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, language.learn(docs.where(~language.held_out(docs, 4, 2)))


def test_held_out_accuracy(learned):
    docs, model = learned
    out = docs.where(language.held_out(docs, 4, 2))
    found = language.detect(out, model, extra=["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in found if r.lang]) >= 0.95


def test_spans_of_mixed_text(spark, learned):
    docs, model = learned
    sample = {r.lang: r.text for r in docs.where("length(text) between 400 and 3000").select("lang", "text").collect()}
    names = sorted(sample)[:2]
    cut = {x: " ".join(sample[x].split()[:60]) for x in names}
    mixed = spark.createDataFrame([(1, cut[names[0]] + " " + cut[names[1]])], "doc_id long, text string")
    row = language.detect(mixed, model).first()
    long = [s.lang for s in row.spans if s.words > 20]
    assert long == names and 0.3 < row.score < 0.7


def test_a_text_in_three_languages_is_kept(spark, learned):
    docs, model = learned
    sample = {r.lang: " ".join(r.text.split()[:80]) for r in docs.where("length(text) between 900 and 3000").select("lang", "text").collect()}
    mixed = spark.createDataFrame([(1, " ".join(sample[x] for x in sorted(sample)[:3]))], "doc_id long, text string")
    assert language.detect(mixed, model).first().score < 0.5
    assert language.keep_known(mixed, model).count() == 1


def test_cases(spark, learned):
    _, model = learned
    rows = [(1, None), (2, ""), (3, "123 ... \n"), (4, "漢字"), (4, "漢字"), (None, "the of and"), (5, "the and of " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id): r for r in language.detect(docs, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred in model.languages and got[5].lang_pred == "en" and got[None].lang_pred == "en"
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4, 5]
    assert language.detect(docs.limit(0), model).count() == 0
    assert language.learn(docs.limit(0)) is None
    assert {r.lang_pred for r in language.detect(docs, None).collect()} == {"und"}
    assert language.keep_known(docs, None).count() == 4
    assert language.learn(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")) is None


def test_a_rare_language_is_learned_from_all_its_rows(spark):
    """Five rows among 805, of which about 60 are drawn."""
    rows = [(k, "the cat and the dog", "en") for k in range(400)] + [(1000 + k, "кот и собака", "ru") for k in range(400)] + [(5000 + k, "კატა და ძაღლი", "ka") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.learn(docs, train_docs=60)
    found = {r.doc_id: r.lang_pred for r in language.detect(docs, model).collect()}
    assert found == {i: lang for i, _, lang in rows}
    assert language.quota([400, 400, 5], 60) == 27.5 and language.quota([3, 4], 60) == 4


def test_a_small_share_is_still_drawn(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the cat' AS text", "IF(id % 500 = 0, 'xx', 'en') AS lang")
    assert language.learn(docs, train_docs=30).weights.shape == (language.BUCKETS, 2)
    drawn = language.learn(docs, train_docs=30).weights
    assert drawn[:, 1].max() > drawn[:, 1].min()
