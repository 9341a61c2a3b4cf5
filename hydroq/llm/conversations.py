"""Repair of conversations: the cheapest edits that make the roles read ``(s?(ua)+)?``, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state), the state one of: nothing yet, after system, after user, after assistant. A forward heap
grows from the entry and a reverse heap from the exits; when they meet, all crossings of equal cost are finished, and the one of least
concatenated audit is taken. Two audits of one node and cost are never a prefix of each other, so each label needs the least one only.

A conversation may be of any length. Sorted rows are cut into blocks; of a block that is not a whole conversation, the
cheapest audits between all its entry and exit states are found. Blocks of one partition, then partitions, are joined by these
costs and the order of the audits alone (``joined``), and the way chosen is handed down again (``ways``).
"""

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from hydroq.llm.catalog import query, table
from hydroq.llm.common import partitions, stage

SPACES = " \t\n\x0b\x0c\r"
STATES = START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state that an inserted or re-roled row leads to
ROLES = (None, "system", "user", "assistant")
LEGAL = {"su", "ua", "au"}
FINE, TRUNCATED, FORCED = range(3)
REROLE, DELETE, INSERT, OPEN_END = 3, 4, 3, 3
CLOSING = {START: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), ASSISTANT: (0, "")}


def steps(row, state):
    """(edits, cost, next state) of consuming ``row``: (initial of the role, fault, copies). All copies but the first are deleted."""
    initial, fault, copies = row
    tail, extra = "D" * (copies - 1), DELETE * (copies - 1)
    yield "D" + tail, DELETE + extra, state
    if fault == FORCED:
        return
    extra += OPEN_END if fault == TRUNCATED else 0
    to = NEXT[state]
    if initial == ROLES[to][0]:
        yield "K" + tail, extra, to
        return
    if initial == "s" and state == START:
        yield "K" + tail, extra, SYSTEM
    yield "R" + tail, REROLE + extra, to


def cheapest(rows, entry, exits, closing=False):
    """(cost, audit) of the cheapest way from ``entry`` over all ``rows`` to one of ``exits``, the least audit at ties; None if there is none.

    Rows may be inserted before each row, and after the last one if ``closing``.
    """
    n = len(rows)
    labels = ({(0, entry): (0, "")}, {(n, x): (0, "") for x in exits})
    heaps = ([(0, 0, entry)], [(0, 0, x) for x in sorted(exits)])
    done = (set(), set())
    best = None

    def forward(i, state):
        if i < n or closing:
            yield "I", INSERT, (i, NEXT[state])
        if i < n:
            for edits, cost, to in steps(rows[i], state):
                yield edits, cost, (i + 1, to)

    def reverse(i, state):
        if i < n or closing:
            for before in STATES:
                if NEXT[before] == state:
                    yield "I", INSERT, (i, before)
        if i:
            for before in STATES:
                for edits, cost, to in steps(rows[i - 1], before):
                    if to == state:
                        yield edits, cost, (i - 1, before)

    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        own, other = labels[side], labels[1 - side]
        # at equal cost, nodes met earlier along the rows come first: keeping a row costs nothing
        cost, rank, state = heappop(heaps[side])
        node = (rank if side == 0 else n - rank, state)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = own[node][1]
        for edits, more, to in (reverse if side else forward)(*node):
            label = (cost + more, edits + audit if side else audit + edits)
            if to not in own or label < own[to]:
                own[to] = label
                heappush(heaps[side], (label[0], n - to[0] if side else to[0], to[1]))
            if to in other:
                total = own[to][0] + other[to][0]
                best = total if best is None else min(best, total)
        if node in other:
            total = cost + other[node][0]
            best = total if best is None else min(best, total)
    if best is None:
        return None
    crossings = [v for v in labels[0].keys() & labels[1].keys() if labels[0][v][0] + labels[1][v][0] == best]
    return best, min(labels[0][v][1] + labels[1][v][1] for v in crossings)


def summary(audits):
    """Of the 16 (cost, audit) or None by entry and exit: costs (-1: no way) and, for each entry, the order of the audits."""
    costs = [-1 if x is None else x[0] for x in audits]
    order = [0] * 16
    for s in STATES:
        known = sorted({x[1] for x in audits[4 * s:4 * s + 4] if x})
        for t in STATES:
            order[4 * s + t] = known.index(audits[4 * s + t][1]) if audits[4 * s + t] else 0
    return costs, order


def joined(parts):
    """The summary of consecutive parts as one."""
    costs, order = parts[0]
    for next_costs, next_order in parts[1:]:
        new = [-1] * 16
        keys = [None] * 16
        for s in STATES:
            for t in STATES:
                ways = [(costs[4 * s + x] + next_costs[4 * x + t], order[4 * s + x], next_order[4 * x + t]) for x in STATES if costs[4 * s + x] >= 0 and next_costs[4 * x + t] >= 0]
                if ways:
                    new[4 * s + t], *keys[4 * s + t] = min(ways)
        costs, order = new, [0] * 16
        for s in STATES:
            known = sorted(tuple(k) for k in keys[4 * s:4 * s + 4] if k)
            for t in STATES:
                order[4 * s + t] = known.index(tuple(keys[4 * s + t])) if keys[4 * s + t] else 0
    return costs, order


def ways(parts, entry, ends):
    """(cost, [(entry, exit) of each part]) of the cheapest way to one of ``ends`` ({exit: cost}), the least audit at ties."""
    rest, choices = dict(ends), []
    for costs, order in reversed(parts):
        new, choice = {}, {}
        for s in STATES:
            options = [(costs[4 * s + x] + rest[x], order[4 * s + x], x) for x in rest if costs[4 * s + x] >= 0]
            if options:
                new[s], _, choice[s] = min(options)
        rest = new
        choices.append(choice)
    way, state = [], entry
    for choice in reversed(choices):
        way.append((state, choice[state]))
        state = choice[state]
    return rest[entry], way


FACTS = ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")
FACT_TYPE = pa.struct([*((c, pa.int64()) for c in FACTS[:7]), ("first", pa.string()), ("last", pa.string())])


def facts_of(rows):
    """Counts of one block: rows are (turn, initial, fault, copies, is blank, is duplicate)."""
    out = dict.fromkeys(FACTS[:5], 0) | {"low": None, "high": None, "first": rows[0][1], "last": rows[-1][1]}
    before = None
    for turn, initial, fault, copies, blank, duplicate in rows:
        out["blank"] += copies if blank else 0
        out["duplicate"] += 0 if blank else copies if duplicate else copies - 1
        out["truncated"] += fault == TRUNCATED
        out["illegal"] += copies - 1 + (before is not None and before + initial not in LEGAL)
        before = initial
        if turn is not None:
            out["distinct"] += turn != out["high"]
            out["low"] = turn if out["low"] is None else out["low"]
            out["high"] = turn
    return out


def facts_joined(parts):
    """The counts of consecutive parts as one."""
    out = dict(parts[0])
    for x in parts[1:]:
        for c in FACTS[:5]:
            out[c] += x[c]
        out["illegal"] += out["last"] + x["first"] not in LEGAL
        out["distinct"] -= x["low"] is not None and x["low"] == out["high"]
        out["low"] = x["low"] if out["low"] is None else out["low"]
        out["high"] = out["high"] if x["high"] is None else x["high"]
        out["last"] = x["last"]
    return out


BLOCK = "conv long, part int, seq int, keys array<binary>, initials array<string>, copies array<long>, cost long, audit string, costs array<long>, ranks array<int>, audits array<string>, "
FACT_SQL = "struct<blank:long,duplicate:long,truncated:long,illegal:long,distinct:long,low:long,high:long,first:string,last:string>"
BLOCK_SQL = BLOCK + f"seg_costs array<long>, seg_ranks array<int>, seg_facts {FACT_SQL}"
BLOCK_TYPE = pa.schema([
    ("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("keys", pa.list_(pa.binary())), ("initials", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("cost", pa.int64()), ("audit", pa.string()),
    ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), ("seg_costs", pa.list_(pa.int64())), ("seg_ranks", pa.list_(pa.int32())), ("seg_facts", FACT_TYPE),
])


def _blocks(most):
    """Sorted lean rows of a partition -> its blocks. The last block of each conversation carries what holds for the whole run of its rows.

    A conversation that is one block and surely lies in this partition alone (neither its first nor its last one) is solved at once.
    """

    def run(batches):
        part, seq, first = TaskContext.get().partitionId(), 0, True
        held, conv, parts, facts = [], None, [], []

        def close(last_block, last_run):
            """The rows held as a block."""
            nonlocal seq, held, parts, facts
            rows = [r[2:5] for r in held]
            facts.append(facts_of([r[1:] for r in held]))
            row = {"conv": conv, "part": part, "seq": seq, "keys": [r[0] for r in held], "initials": [r[2] for r in held], "copies": [r[4] for r in held]}
            if last_block and not parts and not first and not last_run:
                row["cost"], row["audit"] = cheapest(rows, START, {START, ASSISTANT}, closing=True)
            else:
                entries = STATES if first or parts else (START,)
                audits = [cheapest(rows, s, {t}) if s in entries else None for s in STATES for t in STATES]
                costs, order = summary(audits)
                parts.append((costs, order))
                row |= {"costs": costs, "ranks": order, "audits": [x and x[1] for x in audits]}
                if last_block:
                    row["seg_costs"], row["seg_ranks"] = joined(parts)
            if last_block:
                row["seg_facts"] = facts_joined(facts)
                parts, facts = [], []
            held = []
            seq += 1
            return row

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and r["conv"] != conv:
                    out.append(close(True, False))
                    first = False
                elif len(held) == most:
                    out.append(close(False, False))
                conv = r["conv"]
                fault = FORCED if r["blank"] or r["duplicate"] else TRUNCATED if r["open_end"] else FINE
                held.append((r["key"], r["turn"], r["role"][:1], fault, r["copies"], r["blank"], r["duplicate"]))
            yield from pa.Table.from_pylist(out, BLOCK_TYPE).to_batches()
        if held:
            yield from pa.Table.from_pylist([close(True, True)], BLOCK_TYPE).to_batches()

    return run


def _folded(batches):
    """Conversations of several runs -> their cost, facts, closing edits and the way through each run."""
    kind = pa.schema([("conv", pa.int64()), ("cost", pa.int64()), ("tail", pa.string()), ("facts", FACT_TYPE), ("picks", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32())])))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            runs = sorted(r["runs"], key=lambda x: x["part"])
            cost, way = ways([(x["seg_costs"], x["seg_ranks"]) for x in runs], START, {s: c for s, (c, _) in CLOSING.items()})
            picks = [{"part": x["part"], "entry": s, "exit": t} for x, (s, t) in zip(runs, way)]
            out.append({"conv": r["conv"], "cost": cost, "tail": CLOSING[way[-1][1]][1], "facts": facts_joined([x["seg_facts"] for x in runs]), "picks": picks})
        yield from pa.Table.from_pylist(out, kind).to_batches()


def _handed_down(batches):
    """Runs with their entry and exit -> entry and exit of each of their blocks."""
    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            blocks = sorted(r["blocks"], key=lambda x: x["seq"])
            _, way = ways([(x["costs"], x["ranks"]) for x in blocks], r["entry"], {r["exit"]: 0})
            out += [{"part": r["part"], "seq": x["seq"], "entry": s, "exit": t} for x, (s, t) in zip(blocks, way)]
        yield from pa.Table.from_pylist(out, kind).to_batches()


def _edits(batches):
    """Decided blocks -> one row for each row that stays (key; new role if it changes) or is inserted (no key), in order of ``at``."""
    kind = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("at", pa.int32()), ("key", pa.binary()), ("new_role", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            out, state, place, audit = [], r["entry"], 0, r["audit"]

            def add(key, role):
                out.append({"conv": r["conv"], "part": r["part"], "seq": r["seq"], "at": len(out), "key": key, "new_role": role})

            for key, initial, copies in [*zip(r["keys"], r["initials"], r["copies"]), (None, None, 0)]:
                while audit[place:place + 1] == "I":
                    state = NEXT[state]
                    add(None, ROLES[state])
                    place += 1
                edit = audit[place:place + 1]
                if edit == "K":
                    state = SYSTEM if initial == "s" else NEXT[state]
                    add(key, None)
                elif edit == "R":
                    state = NEXT[state]
                    add(key, ROLES[state])
                place += copies
            yield from pa.Table.from_pylist(out, kind).to_batches()


def _digests(batches):
    """Rows sorted by conversation and place -> sha256 of their ``role:text`` lines; nothing but the hash state is held."""
    conv, state = None, None

    def ended():
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv", "digest"])

    for batch in batches:
        for key, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            if state is None or key != conv:
                if state is not None:
                    yield ended()
                conv, state = key, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line)
    if state is not None:
        yield ended()


def ready(rows, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """(conv, turn, role, text): null roles and texts are one space; other columns stay out."""
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))]
    return rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *filled)


def damage(rows):
    """Rows of ``ready`` with faults by crc32(``conv:turn``) % 20: 0 dropped, 1 emptied, 2 without [.!?], 3 twice, 4 with the role user."""
    place = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    out = rows.withColumn("__kind", kind).where("__kind <> 0")
    out = out.withColumn("text", F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__kind", "__copy")


def _key(*columns):
    """16 bytes that tell the values apart: each one with its length."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) if c in ("conv", "turn") else F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns]
    return F.unhex(F.md5(F.concat_ws("/", *texts).cast("binary")))


def repair(rows, block=512):
    """(report, repaired) of ``rows`` (conv, turn, role, text), as ``ready`` makes them.

    report: conv, gaps, blank, duplicate, truncated, illegal, cost, audit for every conversation. repaired: conv, part, seq, at (together the
    order of the rows), turn (null for inserted rows), role, text. Rows are taken by turn, null turns first, then by role and a hash of the
    text. A null conv is one conversation. Faults, edits and costs are those of the module; repeated rows are duplicates. Empty table: no rows.

    Equal rows are counted before any shuffle, and the lattice never sees texts: rows carry hashes. A conversation of any length is
    cut into blocks of ``block`` rows, over several partitions if need be. Only its audit, one string, is put together in one task.
    """
    spark = rows.sparkSession
    trimmed = F.trim(F.col("text"), F.lit(SPACES))
    lean = rows.select("conv", "turn", "role", _key("conv", "turn", "role", "text").alias("key"), _key("conv", "role", "text").alias("pair"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open_end"))
    lean = stage(lean.groupBy(*lean.columns).agg(F.count(F.lit(1)).alias("copies")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = lean.groupBy("pair").agg(F.min(when).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    lean = lean.join(again, "pair", "left").withColumn("duplicate", F.coalesce(when > F.col("earliest"), F.lit(False))).drop("pair", "earliest")
    lean = stage(lean, "faults")
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "key"]
    names = ["conv", "turn", "role", "key", "blank", "open_end", "copies", "duplicate"]
    cut = lean.select(*names).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    blocks = stage(cut.mapInArrow(_blocks(block), BLOCK_SQL), "blocks")

    whole = blocks.where("audit is not null")
    runs = blocks.where("audit is null and seg_costs is not null").groupBy("conv").agg(F.collect_list(F.struct("part", "seg_costs", "seg_ranks", "seg_facts")).alias("runs"))
    folded = stage(runs.mapInArrow(_folded, f"conv long, cost long, tail string, facts {FACT_SQL}, picks array<struct<part:int,entry:int,exit:int>>"), "folded")
    picks = folded.select(F.col("conv").alias("own"), F.explode("picks").alias("p")).select("own", "p.*")
    cells = blocks.where("audit is null")
    by_run = cells.groupBy("conv", "part").agg(F.collect_list(F.struct("seq", "costs", "ranks")).alias("blocks")).withColumnRenamed("part", "run")
    by_run = by_run.join(picks, F.col("conv").eqNullSafe(F.col("own")) & (F.col("run") == F.col("part"))).select("part", "entry", "exit", "blocks")
    chosen = by_run.mapInArrow(_handed_down, "part int, seq int, entry int, exit int")
    names = ["conv", "part", "seq", "keys", "initials", "copies", "entry", "audit"]
    solved = cells.drop("audit").join(chosen, ["part", "seq"]).withColumn("audit", F.get("audits", 4 * F.col("entry") + F.col("exit"))).select(*names)
    decided = stage(whole.withColumn("entry", F.lit(0)).select(*names).union(solved), "decided")

    counts = [(F.col(f"facts.{c}")).alias(c) for c in FACTS[:4]]
    gaps = F.coalesce(F.col("facts.high") - F.col("facts.low") + 1 - F.col("facts.distinct"), F.lit(0)).cast("long").alias("gaps")
    long_audits = decided.join(folded.select(F.col("conv").alias("own"), "tail", "facts", F.col("cost").alias("total")), F.col("conv").eqNullSafe(F.col("own")))
    long_audits = long_audits.groupBy("conv").agg(F.first("facts").alias("facts"), F.first("total").alias("cost"), F.first("tail").alias("tail"), F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))).alias("parts"))
    long_audits = long_audits.withColumn("audit", F.concat(F.array_join("parts.audit", ""), "tail"))
    report = whole.withColumn("facts", F.col("seg_facts")).select("conv", gaps, *counts, "cost", "audit").union(long_audits.select("conv", gaps, *counts, "cost", "audit"))

    tails = folded.where("tail <> ''").select("conv", F.lit(2 ** 31 - 1).alias("part"), F.lit(0).alias("seq"), F.expr("slice(array('user', 'assistant'), 3 - length(tail), length(tail))").alias("roles"))
    tails = tails.select("conv", "part", "seq", F.posexplode("roles").alias("at", "new_role")).select("conv", "part", "seq", "at", F.lit(None).cast("binary").alias("key"), "new_role")

    edits = stage(decided.mapInArrow(_edits, "conv long, part int, seq int, at int, key binary, new_role string").union(tails), "edits")
    texts = rows.select(_key("conv", "turn", "role", "text").alias("key"), "turn", "role", "text").dropDuplicates(["key"])
    place = ["conv", "part", "seq", "at"]
    stay = edits.where("key is not null").join(texts, "key").select(*place, "turn", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.where("key is null").select(*place, F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    return report, stay.union(added)


def digests(repaired):
    """(conv, digest): sha256 of the ``role:text`` lines of each conversation. A digest is read in order, so one task streams a conversation."""
    lines = repaired.select("conv", "part", "seq", "at", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    lines = lines.repartition(partitions(repaired.sparkSession), "conv").sortWithinPartitions("conv", "part", "seq", "at")
    return lines.select("conv", "line").mapInArrow(_digests, "conv long, digest string")


def full_report(rows, damaged, block=512):
    """The report on ``damaged`` with repaired_sha256, one row for every conversation of ``rows`` (both as ``ready`` makes them)."""
    report, repaired = repair(damaged, block)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = rows.select(F.col("conv").alias("conv_id")).distinct()
    report, digest = report.alias("r"), digests(repaired).alias("d")
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("r.conv")), "left").join(digest, F.col("conv_id").eqNullSafe(F.col("d.conv")), "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *(F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in names), F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("d.digest", F.lit(empty)).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), given AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_transform(range(length(place)), lambda i: CAST(ascii(substr(place, i + 1, 1)) AS BIGINT)),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind FROM given, crc
), damaged AS (
  SELECT id, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), ordered AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '-') AS conv, row_number() OVER o AS n, regexp_replace(text, '[ 	-
]', '', 'g') AS solid, left(role, 1) AS initial, lag(left(role, 1)) OVER o AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, copy) > 1 AS seen FROM damaged
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), id, copy)
), faults AS (
  SELECT *, solid = '' AS blank, solid <> '' AND seen AS duplicate, solid <> '' AND NOT seen AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated FROM ordered
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM faults GROUP BY conv_id
), moves(state, inserted, here) AS (
  -- states: 0 start, 1 after system, 2 after user, 3 after assistant
  VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)
), edits AS (
  SELECT conv, n, state, cost + 3 * inserted AS cost, repeat('I', inserted) || edit AS audit, nxt, list_concat(list_transform(range(inserted), lambda k: CASE WHEN state = 2 THEN ['assistant:', 'user:'][k + 1] ELSE ['user:', 'assistant:'][k + 1] END), line) AS lines
  FROM (
    SELECT conv, n, state, inserted, 4 AS cost, 'D' AS edit, here AS nxt, CAST([] AS VARCHAR[]) AS line FROM faults, moves
    UNION ALL
    SELECT conv, n, state, inserted, CASE WHEN truncated THEN 3 ELSE 0 END, 'K', CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, [role || ':' || text] FROM faults, moves
    WHERE NOT blank AND NOT duplicate AND (initial = 's' AND here = 0 OR initial = 'u' AND here <> 2 OR initial = 'a' AND here = 2)
    UNION ALL
    SELECT conv, n, state, inserted, CASE WHEN truncated THEN 6 ELSE 3 END, 'R', CASE WHEN here = 2 THEN 3 ELSE 2 END, [CASE WHEN here = 2 THEN 'assistant:' ELSE 'user:' END || text] FROM faults, moves WHERE NOT blank AND NOT duplicate
  )
), walk AS (
  SELECT DISTINCT conv, 0 AS n, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM faults
  UNION ALL
  SELECT conv, n, state, best.cost, best.audit, best.lines FROM (
    SELECT w.conv, e.n, e.nxt AS state, min({'cost': w.cost + e.cost, 'audit': w.audit || e.audit, 'lines': list_concat(w.lines, e.lines)}) AS best
    FROM walk w JOIN edits e ON w.conv = e.conv AND e.n = w.n + 1 AND e.state = w.state GROUP BY ALL
  )
), ended AS (
  SELECT conv, min({'cost': w.cost + 3 * inserted, 'audit': audit || repeat('I', inserted), 'lines': list_concat(lines, CASE inserted WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['assistant:'] ELSE ['user:', 'assistant:'] END)}) AS best
  FROM walk w JOIN facts f ON w.conv = coalesce(CAST(f.conv_id AS VARCHAR), '-') AND w.n = f.n JOIN moves m ON m.state = w.state AND (here = 3 OR here = 0 AND inserted = 0) GROUP BY conv
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv = coalesce(CAST(c.conv_id AS VARCHAR), '-')
"""


@query("op11_conversation_repair", ORACLE)
def op11(spark, sf_dir):
    rows = ready(table(spark, sf_dir, "conversations"))
    return full_report(rows, damage(rows))
