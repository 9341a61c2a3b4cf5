import hashlib
import re
from collections import defaultdict

from hydroq.llm import line_dedup

EDGE = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in EDGE.sub("", line))


def brute(rows, chars, least):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(-(2 ** 63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= least and max(held[key(x)]) != (-(2 ** 63) if i is None else i))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = (
    [(i, f"a common line\n own {i} \nA COMMON LINE \t\nö{'é' * 9}") for i in range(40)]
    + [(100, None), (101, ""), (None, "a common line\nx"), (102, "a common line"), (102, "a common line\nother text of 102"), (102, "a common line")]
    + [(200 + i, "öööööööööö\n\n a common line ") for i in range(3)]
    + [(300, "\n".join(["long text line"] * 5000)), (301, "long text line"), (302, "long text line"), (303, "x" * 100_000)]
)


def test_report_equals_brute_force(spark, docs_of):
    docs = docs_of(ROWS).withColumnRenamed("source", "keep").repartition(5)
    for chars, least in ((10, 3), (10, 5), (1, 2)):
        got = sorted(map(tuple, line_dedup.line_report(docs, chars, least).collect()), key=repr)
        assert got == brute(ROWS, chars, least)


def test_a_key_over_many_partitions(spark, docs_of):
    rows = [(i, "the one line of all documents") for i in range(3000)] + [(5000 + i, f"own line number {i}") for i in range(50)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(map(tuple, line_dedup.line_report(docs_of(rows).repartition(8), 10, 5).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(brute(rows, 10, 5))
    assert [r[0] for r in got if r[0] < 5000 and not r[2]] == [2999]


def test_drop_lines_keeps_rows_and_columns(spark, docs_of):
    docs = docs_of(ROWS)
    out = line_dedup.drop_lines(docs, 10, 5)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.where("doc_id = 100 and text is null").count() == 1
    assert out.where("doc_id = 3").first()["text"] == " own 3 "
    assert out.where("doc_id = 39").first()["text"] == f" own 39 \nö{'é' * 9}"


def test_no_rows(spark, docs_of):
    docs = docs_of(ROWS).limit(0)
    assert line_dedup.line_report(docs).count() == 0
    assert line_dedup.drop_lines(docs).count() == 0
