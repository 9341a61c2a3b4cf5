import math
import zlib
from collections import Counter

import numpy as np
import pytest

from hydroq.llm import class_lm


def brute_base(rows):
    text = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").encode().decode().replace("\x0b", " ").split(" ")]  # noqa: E731,F841
    tokens = [class_lm.tokens_of((t or "").encode()) for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for x, o in zip(tokens, out) if not o for w in x)
    n, v = sum(counts.values()), len(counts)
    return [(i, o, len(x), sum(counts[w] > 0 for w in x), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for (i, _), o, x in zip(rows, out, tokens)]


def made():
    rng = np.random.default_rng(3)
    verbs, nouns = [f"v{k}" for k in range(12)], [f"n{k}é" for k in range(12)]
    rows = [(k, " ".join(f"{rng.choice(nouns)} {rng.choice(verbs).upper()}{rng.choice(['', ',', '.'])}" for _ in range(rng.integers(1, 30)))) for k in range(120)]
    rows += [(200 + k, f"rare{k} words{k}\t\n{nouns[0]}") for k in range(40)]
    return rows + [(300, None), (301, ""), (302, " \n"), (None, "n1é v1"), (303, "n1é " * 50_000), (5, rows[5][1]), (5, "other v1")]


@pytest.mark.parametrize("head_words", [100_000, 20, 0])
def test_base_score(spark, docs_of, head_words):
    rows = made()
    got = class_lm.score_texts(docs_of(rows).withColumnRenamed("lang", "n").repartition(3), class_words=10, classes=4, head_words=head_words).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_score_does_not_depend_on_the_head(spark, docs_of):
    """Frequent words looked up in the task and rare ones met in the join give the same sums, given one clustering."""
    rows = made()
    docs = docs_of(rows)
    scores = []
    for head_words in (100_000, 40):
        got = class_lm.score_texts(docs, class_words=10, classes=4, head_words=head_words).collect()
        scores.append(sorted((repr(r.doc_id), r.n_tokens, round(r.score, 5)) for r in got))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("head_words", [100_000, 40])
def test_scores_and_classes_equal_brute_force(spark, docs_of, head_words):
    """Every word of five occurrences and more takes the best of all classes; the scores follow from classes and counts."""
    rows = made()
    blocks = class_lm.in_text_blocks(docs_of(rows).select("doc_id", class_lm.held_out(docs_of(rows), 7, 2, "doc_id").alias("held_out"), class_lm.F.coalesce("text", class_lm.F.lit("")).cast("binary").alias("text")).repartition(3), size=3000)
    assert blocks.select("block").distinct().count() > 5
    model, strings, table = class_lm.fit(blocks, class_words=10, classes=4, head_words=head_words, least=5)
    own = {bytes(r["word"]): r["class"] for r in table.collect()}
    texts = [(r.held_out, class_lm.tokens_of(bytes(r.text))) for r in blocks.collect()]
    train = [[class_lm.END, *x] for out, x in texts if not out]
    counts = Counter(w for x in train for w in x[1:])
    assert own.keys() == counts.keys()
    first = {w: model.class_of.get(w, 4 + class_lm.shape_of(w)) for w in counts}
    total = 4 + class_lm.SHAPES
    grid = np.zeros((total, total))
    around = {w: (np.zeros(total), np.zeros(total)) for w in counts}
    for x in train:
        for a, b in zip(x, x[1:]):
            grid[first[a], first[b]] += 1
            around[a][0][first[b]] += 1
            around[b][1][first[a]] += 1
    clustered = 0
    for w, n in counts.items():
        if w in model.class_of or n < 5:
            assert own[w] == first[w]
            continue
        gains = []
        for b in range(4):
            after, before = around[w]
            f = class_lm._f
            gains.append((f(grid[b] + after) - f(grid[b])).sum() + (f(grid[:, b] + before) - f(grid[:, b])).sum() - f(grid[b].sum() + n) + f(grid[b].sum()) - f(grid[:, b].sum() + n) + f(grid[:, b].sum()))
        assert gains[own[w]] >= max(gains) - 1e-6
        clustered += 1
    assert clustered > 10 and len(model.class_of) == 10
    number = lambda w: own.get(w, 4 + class_lm.shape_of(w))
    moves, tokens, sizes = np.zeros((total, total)), np.zeros(total), np.zeros(total)
    for x in train:
        for a, b in zip(x, x[1:]):
            moves[number(a), number(b)] += 1
    for w, n in counts.items():
        tokens[own[w]] += n
        sizes[own[w]] += 1
    chance = lambda a, b: (moves[number(a), number(b)] + 0.1) / (moves[number(a)].sum() + 0.1 * total) * (counts[b] + 1) / (tokens[number(b)] + sizes[number(b)] + 1)
    want = sorted(sum(math.log10(chance(a, b)) for a, b in zip([class_lm.END, *x], x)) for _, x in texts)
    got = sorted(r.score for r in class_lm.score(strings, model).collect())
    assert np.allclose(got, want)


def test_chances_add_up_to_one():
    rng = np.random.default_rng(1)
    words = {f"w{k}".encode(): int(rng.integers(1, 50)) for k in range(30)} | {b"x.": 3, b"y,": 2, class_lm.END: 7}
    class_of = {w: k % 3 for k, w in enumerate(list(words)[:20])}
    total = 3 + class_lm.SHAPES
    tokens, sizes = np.zeros(total), np.zeros(total)
    model = class_lm.Model(words, class_of, 3, rng.integers(0, 9, (total, total)).astype(float), sum(words.values()), len(words), tokens, sizes, 1.0, 0.1)
    for w, n in words.items():
        tokens[model.class_number(w)] += n
        sizes[model.class_number(w)] += 1
    model = class_lm.Model(words, class_of, 3, rng.integers(0, 9, (total, total)).astype(float), sum(words.values()), len(words), tokens, sizes, 1.0, 0.1)
    assert np.allclose((10.0 ** model.transition).sum(1), 1)
    mass = np.zeros(total)
    for w, n in words.items():
        c = model.class_number(w)
        mass[c] += 10.0 ** (math.log10(n + 1.0) - model.share[c])
    mass += 10.0 ** (math.log10(0 + 1.0) - model.share)  # one unknown word in each class
    assert np.allclose(mass, 1)


def likelihood(pairs, own):
    k = own.max() + 1
    grid = np.zeros((k, k))
    np.add.at(grid, (own[:, None], own[None, :]), pairs)
    return class_lm._f(grid).sum() - class_lm._f(grid.sum(1)).sum() - class_lm._f(grid.sum(0)).sum()


def test_exchange_finds_classes_and_a_local_optimum():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 3, 30)
    chance = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    pairs = rng.poisson(40 * chance[truth[:, None], truth[None, :]]).astype(float)
    own = class_lm.exchange(pairs, 30, 3, sweeps=20)
    assert len({(a, b) for a, b in zip(own.tolist(), truth.tolist())}) == 3
    best = likelihood(pairs, own)
    for w in range(30):
        for b in range(3):
            other = own.copy()
            other[w] = b
            assert likelihood(pairs, other) <= best + 1e-6


def test_better_than_the_base_on_held_out_texts(spark):
    got = class_lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_no_rows(spark, docs_of):
    docs = docs_of([(1, "a b")])
    assert class_lm.score_texts(docs.limit(0)).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = class_lm.score_texts(docs_of([(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_marks_hold_every_word_and_few_others(spark):
    own = [f"wört{k}".encode() for k in range(5000)]
    marks = class_lm.marks_of(spark.createDataFrame([(bytearray(w),) for w in own], "word binary"))
    assert len(marks) * 8 == class_lm.MARKS
    assert all(class_lm.marked(marks, w) for w in own)
    assert sum(class_lm.marked(marks, b"x%d" % k) for k in range(5000)) < 25
    assert not any(class_lm.marks_of(spark.createDataFrame([], "word binary")))


ODD = [b"", b" A\tb\x0b", b"\n", b"x\xff Y\x00 \xc2\xa0b ", "É é ж, 日本. 😀".encode(), b"\xc3 a\xc3b \xe2\x82 \xc0\xaf 1 . b B b", b"\xc3", b"\xa9x"]


def test_texts_become_the_numbers_of_their_words():
    texts = class_lm.pa.array([b"cut off", *ODD], class_lm.pa.binary()).slice(1)
    codes, words, size = class_lm.coded(texts)
    words = words.to_pylist()
    assert [words[c] for c in codes] == [w for t in ODD for w in class_lm.tokens_of(t)]
    assert size.tolist() == [len(class_lm.tokens_of(t)) for t in ODD] and len(set(words)) == len(words)
    for numbers in (codes, codes * 0, codes * 70_000, codes + (1 << 40)):
        assert class_lm.unpacked(class_lm.packed(numbers), len(numbers)).tolist() == numbers.tolist()


def test_spelling_and_marks_of_many_words_equal_those_of_one():
    words = class_lm.coded(class_lm.pa.array(ODD, class_lm.pa.binary()))[1]
    marks = np.random.default_rng(5).bytes(class_lm.MARKS // 8)
    for part in (words, words.slice(2, 5), words.slice(0, 0)):
        assert class_lm.shapes_of(part).tolist() == [class_lm.shape_of(w) for w in part.to_pylist()]
        assert class_lm.all_marked(marks, part).tolist() == [bool(class_lm.marked(marks, w)) for w in part.to_pylist()]


def test_sums_of_neighbours_cross_batches():
    """Rows of one word in several batches are one sum, whatever is held of them at once."""
    pa = class_lm.pa
    rows = [(b"a", [0, 3]), (b"b", [1, 1, 5]), (b"b", [1]), (b"b", [2, 200]), (b"c", [0])]
    want = {}
    for word, cells in rows:
        want.setdefault(word, np.zeros(210, int))[:] += np.bincount(cells, minlength=210)
    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([bytes(c) for _, c in rows], pa.binary())], ["word", "near"])
    for cut in range(len(rows) + 1):
        got = [(w, s) for words, sums in class_lm.near_sums([batch.slice(0, cut), batch.slice(cut)], 105) for w, s in zip(words.to_pylist(), sums)]
        assert [w for w, _ in got] == sorted(want) and all((s == want[w]).all() for w, s in got)


def test_no_text_is_written_and_each_is_read_once(spark, docs_of, monkeypatch):
    """Texts are cut into words in one pass; what is written and dealt are numbers of words."""
    written, stage = {}, class_lm.stage

    def spy(df, name):
        assert name not in written
        written[name] = df.columns
        return stage(df, name)

    monkeypatch.setattr(class_lm, "stage", spy)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = made()
    docs = docs_of(rows).select("doc_id", "text")
    got = class_lm.score_texts(docs.mapInArrow(count, docs.schema), class_words=10, classes=4, head_words=40).collect()
    assert len(got) == len(rows) == read.value
    assert not [n for n, columns in written.items() if {"text", "packed"} & set(columns)]


def test_rare_words_in_several_blocks(spark, docs_of):
    """A block's own count of a word stands only if no other block has the word."""
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 == 2][:20]
    free = [k for k in range(400) if zlib.crc32(str(k).encode()) % 7 != 2][:60]
    rows = [(k, f"all own{k} twice{j // 2} part{j % 20} part{j % 20}") for j, k in enumerate(free)] + [(k, f"all new{k} twice{j} part{j} own{free[j]} unheard") for j, k in enumerate(held)]
    frame = docs_of(rows)
    texts = frame.select("doc_id", class_lm.held_out(frame, 7, 2, "doc_id").alias("held_out"), class_lm.F.col("text").cast("binary").alias("text")).coalesce(1)
    for head_words in (100, 1):
        blocks = class_lm.in_text_blocks(texts, most=3)
        assert blocks.select("block").distinct().count() > 20
        model, strings, _ = class_lm.fit(blocks, class_words=2, classes=2, head_words=head_words)
        got = sorted(map(tuple, class_lm.score(strings, model).collect()))
        for a, b in zip(got, sorted(brute_base(rows)), strict=True):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5])
