import hashlib
import random
import zlib

import pytest

from hydroq.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int"
WS = " \t\n\x0b\x0c\r"


def key_of(conv, turn, role, text):
    return hashlib.md5("/".join(["-" if conv is None else str(conv), "-" if turn is None else str(turn), f"{len(role)}:{role}", f"{len(text)}:{text}"]).encode()).digest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def best_edits(rows):
    """Plain dynamic programme: rows (role, text, forced, truncated); best (cost, audit, lines) by state."""
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                to = 3 if s == 2 else 2
                new = (cost + 3, audit + "I", (*lines, ("assistant:" if to == 3 else "user:")))
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    for role, text, forced, truncated in rows:
        new = {}
        for s, (cost, audit, lines) in inserted(best).items():
            options = [(s, 4, "D", ())]
            if not forced:
                to = 3 if s == 2 else 2
                more = 3 if truncated else 0
                options.append((to, 3 + more, "R", (f"{'assistant' if to == 3 else 'user'}:{text}",)))
                kept = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                if kept is not None:
                    options.append((kept, more, "K", (f"{role}:{text}",)))
            for to, more, edit, line in options:
                found = (cost + more, audit + edit, lines + line)
                if to not in new or found < new[to]:
                    new[to] = found
        best = new
    best = inserted(best) if rows else best
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows, hurt):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), key_of(*r)))
        turns = [r[1] for r in own if r[1] is not None]
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = text.strip(WS)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit, lines = best_edits([(r[2], r[3], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows, block=512, hurt=None, parts=3):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    given = c.ready(frame)
    got = c.full_report(given, c.damage(given) if hurt is None else given, block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = got.collect()
    clean = [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows]
    assert {r.conv_id: tuple(r)[1:] for r in found} == brute(rows, damaged(rows) if hurt is None else clean)
    assert len(found) == len({r[0] for r in rows})


def made(rng, conv, n):
    text = lambda: rng.choice(["", " ", "yes.", "no", "Why?", "Well!  ", "é", f"text {rng.random()}.", f"open {rng.random()}"])
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice([text(), text(), None])) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 3, 512])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows = [r for conv in [None, *range(60)] for r in made(rng, conv, rng.randrange(1, 9))]
    rows += made(rng, 1000, 90) + made(rng, 1001, 40)
    check(spark, rows + rows[:30], block)
    check(spark, rows + rows[:30], block, hurt=False)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(5)
    rows = made(rng, 7, 300) + [(7, 3, "user", "again.")] * 100 + [r for conv in range(10, 30) for r in made(rng, conv, 3)]
    check(spark, rows, 16, parts=5)


def test_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_long_texts_all_dropped_and_no_rows(spark):
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    check(spark, [(5, gone, "user", "x."), (6, 1, "user", "word " * 200_000 + "."), (6, 2, "assistant", "y" * 300_000)])
    given = c.ready(spark.createDataFrame([], SCHEMA))
    assert c.full_report(given, c.damage(given)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", ""), (2, None, "user", "q?")]
    report, repaired = c.repair(c.ready(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)))
    place = ["conv", "part", "seq", "at"]
    assert [(r.conv, r.turn, r.role, r.text) for r in repaired.orderBy(place).collect()] == [(1, 0, "system", "s."), (1, None, "user", ""), (1, 1, "assistant", "a."), (2, None, "user", "q?"), (2, None, "assistant", "")]
    assert {r.conv: (r.cost, r.audit) for r in report.collect()} == {1: (7, "KIKD"), 2: (3, "KI")}


@pytest.mark.parametrize("seed", range(30))
def test_the_lattice_alone(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["user", "assistant", "system", "tool"]), "", f == 2, f == 1) for f in rng.choices([0, 1, 2], [5, 2, 1], k=rng.randrange(0, 14))]
    lean = [(r[0][:1], c.FORCED if r[2] else c.TRUNCATED if r[3] else c.FINE, 1) for r in rows]
    want = best_edits(rows)[:2]
    assert c.cheapest(lean, c.START, {c.START, c.ASSISTANT}, closing=bool(rows)) == want
    cuts = sorted({0, len(lean), *(rng.randrange(len(lean) + 1) for _ in range(3))})
    if rows:
        parts = [c.summary([c.cheapest(lean[a:b], s, {t}) for s in c.STATES for t in c.STATES]) for a, b in zip(cuts, cuts[1:])]
        ends = {s: cost for s, (cost, _) in c.CLOSING.items()}
        cost, way = c.ways(parts, c.START, ends)
        audit = "".join(c.cheapest(lean[a:b], s, {t})[1] for (a, b), (s, t) in zip(zip(cuts, cuts[1:]), way)) + c.CLOSING[way[-1][1]][1]
        assert (cost, audit) == want
        assert c.ways([c.joined(parts)], c.START, ends)[0] == cost
