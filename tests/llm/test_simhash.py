import random
from collections import Counter

import pytest
import xxhash

from hydroq.llm import simhash
from hydroq.llm.components import components


def brute_print(text, width=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) > width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(links):
    """Smallest node reachable, by repeated merging."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(100)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_roots([x for x in links if x[0] != x[1]])
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_value_lies_within_one_bit_of_its_home():
    rng = random.Random(1)
    for width in (21, 22):
        column, flips = simhash.covering(width, 2)
        for _ in range(200):
            x = rng.randrange(1 << width)
            s = 0
            for b in range(width):
                s ^= int(column[b]) * (x >> b & 1)
            assert flips[s][0].bit_count() <= 1
            assert all(not sum_syndrome(x ^ m, column) for m in flips[s])


def sum_syndrome(x, column):
    s = 0
    for b, c in enumerate(column):
        s ^= int(c) * (x >> b & 1)
    return s


def test_links_equal_all_pairs(spark):
    """All pairs within the distance, also in a group so large that its cells are cut."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(60)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(6):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))))
    prints |= {centres[0] ^ (1 << a) ^ (1 << b) for a in range(50) for b in range(a)}
    own = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x, x) for x in own], "node long, fingerprint long")
    got = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    u = [x & (1 << 64) - 1 for x in own]
    want = brute_roots([(own[i], own[j]) for i in range(len(u)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 4])
    assert got == want


def text_rows():
    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma", "déjà", "Über", "x", "yy", "zzz", " ", "q1"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i % 7].upper() + "\n") for i in range(30)]
    return rows + [(200, None), (201, ""), (202, " \t\n\x0b"), (None, base[3]), (5, base[5]), (203, "word " * 30_000), (204, "one two three")]


def test_report_equals_brute_force(spark, docs_of):
    rows = text_rows()
    got = simhash.near_duplicates(docs_of(rows).withColumnRenamed("lang", "fingerprint").repartition(3)).collect()
    prints = [brute_print(t) for _, t in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{p:016x}") for (i, _), p in zip(rows, prints))
    roots = brute_roots([(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for k, (i, _) in enumerate(rows):
        r = roots.get(k, k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least.get(roots.get(k, k))) for k, (i, _) in enumerate(rows))


def test_keep_first(spark, docs_of):
    docs = docs_of([(3, "a b c d e f g h"), (9, "A b c d e f g h"), (4, "other words than those of the first one"), (None, "a b c d e f g h")])
    assert sorted(r.doc_id or -1 for r in simhash.keep_first(docs).collect()) == [-1, 3, 4]
    assert simhash.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c d", "a b c d e", "a " * 700_000])
def test_fingerprint(text):
    if len(text) < 100:
        assert simhash.fingerprint_of(text.encode()) == brute_print(text)
    else:
        assert simhash.fingerprint_of(text.encode()) == xxhash.xxh64_intdigest("a a a a".encode(), 42)
