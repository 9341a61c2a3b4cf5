import math
import random
from collections import Counter

import numpy as np
import pytest

from hydroq.llm import pieces

TEXTS = [
    "", " ", "   ", "\n", "Hello world", "  two  spaces \n\n and\tlines\r\n", "▁ mark ▁▁x", "é漢字 кириллица 🤖👩‍👩‍👧", "\x00\x01 control", "a" * 3000, "in the " * 200, "한국어 텍스트", "x▁ y ", "ﬁ ligature ｆｕｌｌ", "\ufeffbom", "\U0010ffff",
]


@pytest.fixture(scope="module")
def rows():
    return pieces.vocabulary()


@pytest.fixture(scope="module")
def lattice(rows):
    return pieces.Lattice(rows)


def test_decoding_gives_the_text_again(lattice):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abé \n▁漢🤖the in") for _ in range(rng.randrange(80))) for _ in range(300)]
    ids, counts = lattice.sample(texts, pieces.row_seeds(range(len(texts)), texts, 1))
    cuts = np.r_[0, np.cumsum(counts)]
    assert [lattice.text_of(ids[a:b].tolist()).decode() for a, b in zip(cuts, cuts[1:])] == texts


def test_a_row_is_sampled_alike_in_any_company(lattice):
    seeds = pieces.row_seeds([4], ["in the international world"], 1)
    alone = lattice.sample(["in the international world"], seeds)[0]
    many = lattice.sample(["zzz", "in the international world", "in the world"], np.r_[seeds, seeds, seeds])
    at = many[1][0]
    assert (many[0][at:at + many[1][1]] == alone).all()
    other = [tuple(lattice.sample(["in the international world"], pieces.row_seeds([k], ["in the international world"], 1))[0]) for k in range(40)]
    assert len(set(other)) > 3


def ways(text, known):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in known:
            for rest in ways(text[n:], known):
                yield (known[text[:n]],) + rest


@pytest.mark.parametrize("sharpness", [0.0, 0.5, 1.0])
def test_segmentations_come_with_their_exact_chances(rows, sharpness):
    lattice = pieces.Lattice(rows, sharpness)
    known = {t: k for k, (t, s, _) in enumerate(rows) if t is not None}
    unit = "▁thein"
    weight = {w: math.exp(sum(lattice.weight[k] for k in w)) for w in ways(unit, known)}
    total, n = sum(weight.values()), 40_000
    texts = [" thein"] * n
    ids, counts = lattice.sample(texts, pieces.row_seeds(range(n), texts, 1))
    cuts = np.r_[0, np.cumsum(counts)]
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:]))
    assert set(seen) <= set(weight)
    for w, x in weight.items():
        p = x / total
        assert abs(seen[w] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_operator(spark, docs_of):
    rows = list(enumerate(TEXTS)) + [(900, None), (None, "no id"), (3, "\n"), (4, "other text of 4")]
    docs = docs_of(rows).repartition(3)
    got = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    assert all(r.decoded == r.text for r in got)
    assert all((r.piece_ids is None) == (r.text is None) for r in got)
    again = {(r.doc_id, r.text): r.piece_ids for r in pieces.encode(docs.repartition(1)).collect()}
    assert all(again[r.doc_id, r.text] == r.piece_ids for r in got)
    report = pieces.encode_and_check(docs).collect()
    assert len(report) == len(rows) and all(r.lossless for r in report)
    assert {(r.doc_id, r.n_bytes): r.piece_ids for r in report}[4, 11] == again[4, "Hello world"]
    assert pieces.encode(docs.limit(0)).count() == 0 and pieces.encode_and_check(docs.limit(0)).count() == 0
