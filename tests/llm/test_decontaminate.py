import random
import re

import duckdb
import pandas as pd

from hydroq.llm import catalog, decontaminate


def runs(text, width):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, items):
    out, own, docs = set(), {}, list(docs)
    for j, u in items:
        q = runs(u, 5)
        width = min(5, max((len(x.split()) for x in q), default=5))
        if width not in own:
            own[width] = [(i, runs(t, width)) for i, t in docs]
        for i, s in own[width]:
            if q and len(q & s) / len(q) >= 0.8:
                out.add((i, j, len(q), len(q & s), len(q & s) / len(q)))
    return out


def made():
    rng = random.Random(6)
    word = lambda: rng.choice(["in", "the", "Éclair", "of", "thon", "ing", "x1", "über", "a", "b", "cc", "ddd"]) + rng.choice(["", "", ",", ".", "-z"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.choice([5, 6, 9, 14, 15, 16, 31, 33, 60]))) for k in range(40)]
    items += [(50, "two words"), (55, "Paris is nice"), (56, "Zebra!"), (57, "four words, in-line"), (58, "four words in line"), (51, ""), (52, None), (53, "... !!"), (None, text(20)), (54, items[3][1]), (3, items[3][1]), (3, text(12))]
    docs = [(k, text(rng.randrange(0, 90))) for k in range(30)]
    for k, (_, item) in enumerate(items):
        words = (item or "").split()
        for m, share in enumerate((0.0, 0.03, 0.1, 0.3)):
            kept = [w if rng.random() > share else "changed" for w in words]
            docs.append((100 + 10 * k + m, text(rng.randrange(0, 30)) + " " + " ".join(kept).upper() + " " + text(rng.randrange(0, 30))))
    return docs + [(900, None), (901, ""), (902, "Two  WORDS!"), (906, "He said: paris is NICE, and left with two words for a zebra."), (907, "four words in line " + text(9_000)), (908, "paris is not nice, two more words"), (909, "is nice paris"), (910, "zebra"), (911, "nice four words in"), (903, text(40_000) + " " + items[0][1]), (904, "?!"), (905, items[5][1]), (905, items[5][1]), (905, items[6][1]), (None, items[7][1])], items


def test_equals_brute_force(spark, docs_of):
    docs, items = made()
    bench = spark.createDataFrame([(j, u, 1) for j, u in items], "item_id long, text string, doc_id int")
    own = docs_of(docs).withColumnRenamed("source", "item_id").repartition(3)
    got = {tuple(r) for r in decontaminate.contained(own, bench).collect()}
    assert got == brute(docs, items)
    assert len({r[0] for r in got}) > 40
    kept = decontaminate.decontaminate(own, bench)
    assert kept.columns == own.columns
    hit = {r[0] for r in got}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(i if i is not None else -1 for i, _ in docs if i is None or i not in hit)


def test_a_passage_of_most_documents(spark, docs_of):
    item = "one two three four five six seven eight nine ten"
    docs = docs_of([(k, f"own {k} {item} more {k}") for k in range(500)] + [(900 + k, f"other text {k}") for k in range(100)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contained(docs, bench).count() == 500


def test_no_rows(spark, docs_of):
    docs = docs_of([(1, "a b c d e f")])
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained(docs.limit(0), bench).count() == 0
    assert decontaminate.contained(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 1


def test_no_python_in_the_plan(spark, docs_of, capsys):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    decontaminate.contained(docs_of([(1, "a")]), bench).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_short_items_inside_long_texts(spark, docs_of):
    docs = docs_of([(1, "they say paris is nice all the year"), (2, "paris is so nice"), (3, "Paris is nice"), (4, "so paris is nice"), (5, "x"), (6, None), (7, "a x b " * 3_000)])
    bench = spark.createDataFrame([(1, "paris is nice"), (2, "X"), (3, "")], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contained(docs, bench).collect()}
    assert got == {(1, 1, 1, 1, 1.0), (3, 1, 1, 1, 1.0), (4, 1, 1, 1, 1.0), (5, 2, 1, 1, 1.0), (7, 2, 1, 1, 1.0)}


def test_sql_of_short_items():
    con = duckdb.connect()
    docs, items = made()
    con.register("documents", pd.DataFrame([(i, t) for i, t in docs if i is not None and i != 905], columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame([(i, t) for i, t in items if i is not None and i != 3], columns=["item_id", "text"]))
    got = {tuple(r) for r in con.execute(catalog.ORACLES["op3_decontaminate"]).fetchall()}
    assert got == brute([d for d in docs if d[0] is not None and d[0] != 905], [i for i in items if i[0] is not None and i[0] != 3])
