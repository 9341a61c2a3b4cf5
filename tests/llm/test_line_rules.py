import re

import pytest
from pyspark.sql import functions as F

from hydroq.llm import line_rules as q

WS = re.compile(r"[\x20\x09-\x0D]+")


def rule_of(line):
    t = line.strip(q.SPACES)
    if not t:
        return None
    words = re.sub(r"^[\W_]+|[\W_]+$", "", t)
    if re.fullmatch(f"(?i)({q.NAVIGATION_WORDS})", words) or sum(t.count(c) for c in "|»›•·→") >= 2 and len(WS.split(t)) <= q.SHORT_LINE:
        return "navigation"
    if any(x in t.lower() for x in q.BOILERPLATE) or t.lower().startswith(q.LICENSE_STARTS):
        return "boilerplate"
    end = t.rstrip(q.CLOSERS)
    return None if end and end[-1] in q.MARKS else "punctuation"


def brute(doc_id, text):
    text = text or ""
    words = [w for w in WS.split(text) if w]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeat = len({i + k for own in places.values() if len(own) > 1 for i in own for k in range(3)})
    lines = text.split("\n")
    full = [x for x in lines if WS.sub("", x)]
    rules = [rule_of(x) for x in lines]
    chars = sum(map(len, words))
    lost = sum(len(WS.sub("", x)) for x, r in zip(lines, rules) if r)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return {
        "doc_id": doc_id, "n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in q.SYMBOLS), "n_dup_lines": len(full) - len(set(full)), "n_repeat_words": repeat,
        "base_failed": failed, "kept": not failed and lost <= 0.3 * chars, "n_lines": len(lines), **{f"n_{r}": rules.count(r) for r in q.RULES}, "lost_chars": lost,
        "clean_text": "\n".join(x for x, r in zip(lines, rules) if r is None),
    }


PROSE = " ".join(f"word{k} and" for k in range(40)) + " end."
TEXTS = [
    None, "", " \n\t\n", "one", "a b c", "a a a a a", "a b c a b c", PROSE, PROSE + "\n" + PROSE, "HOME\n" + PROSE + "\n[ Read more ]\nNext »", "Home | News | Sport\n" + PROSE,
    PROSE + "\nCopyright (c) 2020 Someone. All Rights Reserved.\nLicensed under the MIT License.\nPlease enable JavaScript!", PROSE + "\nno mark at the end\n*** --- ***\n" + PROSE.replace("and", "or"),
    "no mark " * 40 + "\n" + PROSE, PROSE + '\n“Quoted.”\n(done!)\n"Was it?"\n终わり。\n…\n*\n)', "Ünïcode é # $ % & | < > * text.\n\x0b\x0c\r\nÜnïcode é # $ % & | < > * text.\n", "x " * 60_000, " ".join(f"w{k % 30_000}" for k in range(60_001)) + ".",
    "\n".join(f"line {k}." for k in range(5000)), "a" * 200_000, "İstanbul cookie POLICY ſ", PROSE + "\r\n" + PROSE + "\r\n",
]


@pytest.fixture(scope="module")
def found(spark, docs_of):
    rows = list(enumerate(TEXTS)) + [(None, PROSE), (3, "one"), (3, "one")]
    docs = docs_of(rows).withColumnsRenamed({"source": "kept", "lang": "text2"}).withColumn("n_words", F.lit("x"))
    return rows, q.judged(docs.repartition(3)).collect()


def test_equals_brute_force(found):
    rows, got = found
    assert sorted((repr(sorted(r.asDict().items())) for r in got)) == sorted(repr(sorted(brute(*r).items())) for r in rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute(r.doc_id, r.text) for r in docs.collect()}
    assert {r.doc_id: r.asDict() for r in q.judged(docs).collect()} == want


def test_kept_rows_have_all_columns_and_clean_texts(spark, docs_of):
    docs = docs_of([(1, "HOME\n" + PROSE), (2, "short"), (None, PROSE), (4, None)]).withColumnRenamed("lang", "doc id")
    out = q.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted((repr(r.doc_id), r.text, r.source, r.n_chars) for r in out.collect()) == [("1", PROSE, "s0", len(PROSE) + 5), ("None", PROSE, "s2", len(PROSE))]


def test_no_rows(docs_of):
    assert q.judged(docs_of([])).count() == 0 and q.keep_good(docs_of([])).count() == 0


def test_the_plan_stays_in_the_jvm_and_shuffles_nothing(spark, sf_dir):
    plan = q.op12(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
