import random
from collections import Counter, defaultdict

import pytest

from hydroq.llm import suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\x01" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def made(rng):
    words = ["in", "the", "éclair", "of", "thon", "ing", "or\n", "über", "a", "b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = text(40), text(60)
    rows = [(i, text(rng.randrange(1, 300))) for i in range(60)]
    rows += [(100 + i, text(rng.randrange(0, 40)) + passage + text(rng.randrange(0, 40))) for i in range(25)]
    rows += [(200 + i, text(20) + other[i:] + text(9) + other[:-i or None]) for i in range(10)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 20, 2)] + [(5, rows[5][1]), (5, "another text of 5 " + passage)]
    rows += [(400, None), (401, ""), (None, rows[7][1]), (402, "x" * 1000), (403, "ab" * 700), (404, "Reen " * 300), (405, "x" * 81), (406, "\x00" * 200)]
    near = rows[3][1] * 2
    rows += [(500 + i, near[:50 + 7 * i] + "#" + near[51 + 7 * i:]) for i in range(30)]
    return rows


@pytest.mark.parametrize("large", [4096, 3])
def test_equals_brute_force(spark, docs_of, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", large)
    rows = made(random.Random(8))
    got = suffix_dedup.without_repeats(docs_of(rows).withColumnRenamed("lang", "row").repartition(4), 80).collect()
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got), key=repr) == brute(rows, 80)


def test_long_texts_are_cut_into_segments(spark, docs_of, monkeypatch):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdef") for _ in range(5000))
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(3000 + i)) + shared) for i in range(4)]
    texts = [t.encode() for _, t in rows]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    starts = defaultdict(list)
    for group in suffix_dedup._segments(texts, 400):
        for k, at, part in group:
            starts[k] += range(at, at + len(part) - 399)
    assert all(starts[k] == list(range(len(t) - 399)) for k, t in enumerate(texts))
    got = suffix_dedup.without_repeats(docs_of(rows)).collect()
    assert sorted(tuple(r[:4]) + (bytes(r[4]),) for r in got) == brute(rows, 400)


def test_repeated_starts_equals_hash_counts():
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    pieces = []
    for _ in range(40):
        x = bytearray(base)
        for _ in range(rng.randrange(3)):
            x[rng.randrange(300)] = rng.choice(b"abc")
        cut = rng.randrange(0, 20)
        pieces.append((bytes(x[cut:250 + rng.randrange(50)]), 100 - cut if 100 - cut <= 136 else 136))
    marks, lead = suffix_dedup.repeated_starts(pieces, 200)
    seen = Counter((s + lead[k], t[s:s + 200]) for k, (t, _) in enumerate(pieces) for s in range(len(t) - 199))
    for k, (t, _) in enumerate(pieces):
        for s in range(len(t) - 199):
            assert marks[s + lead[k], k] == (seen[s + lead[k], t[s:s + 200]] > 1)


def test_no_rows(spark, docs_of):
    assert suffix_dedup.without_repeats(docs_of([(1, "a")]).limit(0)).count() == 0
