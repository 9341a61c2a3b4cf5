"""Each stage of the pipeline against a brute-force version, on the stage's own input."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hydroq.llm import language
from test_decontaminate import brute as contained
from test_line_dedup import key
from test_simhash import brute_print, brute_roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, written and read as the driver does it."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        step(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert [sorted(b.columns) for _, b in steps[:-1]] == [sorted(COLUMNS)] * 4
    assert sorted(steps[-1][1].columns) == sorted([*COLUMNS, "piece_ids", "lossless"])


def test_language(steps):
    before, after = map(texts_of, steps[0])
    model = language.learn(steps[0][0])
    kept = set()
    for i, t in before.items():
        _, (share,), (letters,), (spans,) = language.labelled([t or ""], model, 12.0)
        if letters and (share >= 0.5 or 2 * sum(n for _, n in spans if n >= 10) >= sum(n for _, n in spans)):
            kept.add(i)
    assert after == {i: before[i] for i in kept}
    assert len(after) > 0.98 * len(before)


def test_lines(steps):
    before, after = map(texts_of, steps[1])
    holders = {}
    for i, t in before.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    assert after == {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in before.items()}
    assert after != before
    assert all(r.n_chars == len(r.text) for r in steps[1][1].collect())


def test_near_copies(steps):
    """By the fingerprints of four-word runs alone, as the operator's contract has it: all pairs at four or fewer differing bits."""
    before, after = map(texts_of, steps[2])
    prints = {i: brute_print(t) for i, t in before.items()}
    ids = sorted(prints)
    roots = brute_roots([(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert after == {i: t for i, t in before.items() if roots.get(i, i) == i}
    assert 0 < len(after) < len(before)


def test_benchmark(spark, sf_dir, steps):
    before, after = map(texts_of, steps[3])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {x[0] for x in contained(before.items(), items)}
    assert after == {i: t for i, t in before.items() if i not in hit}


def test_pieces(steps):
    before, after = map(texts_of, steps[4])
    assert before == after
    assert all(r.lossless and (len(r.piece_ids) > 0) == bool(r.text) for r in steps[4][1].collect())


def test_run_is_all_stages(spark, sf_dir, steps):
    got = entry.queries()["pipeline"](spark, sf_dir)
    last = steps[-1][1]
    assert sorted(got.columns) == sorted(last.columns)
    assert sorted(map(repr, got.select(sorted(got.columns)).collect())) == sorted(map(repr, last.select(sorted(last.columns)).collect()))


def test_nulls_empty_texts_and_no_rows(spark, sf_dir, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "some words of a text"), (3, "some words of a text"), (3, "some words of a text"), (4, "x " * 60_000)]).withColumnRenamed("source", "component_id")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, out, sf_dir)
        assert out.count() == (4 if rows is docs else 0)
