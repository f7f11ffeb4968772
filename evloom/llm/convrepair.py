"""Repair of conversations by the cheapest edits (operator 13).

Rows of a conversation, in order of turn, are kept, given another role, deleted, or joined by inserted
empty turns, so that the initials of the roles read `(s?(ua)+)?`.  Costs: Keep 0, Rerole 3, Delete 4,
Insert 3, and 3 more for a truncated row that stays.  Blank and duplicate rows have to go.

A backward pass finds the cost to go from each (row, grammar state); a forward walk takes, among the edits that
are tight with it, the one whose initial (D, I, K, R) is least, so of all cheapest audits the ASCII-least is
found.  An edit's initial and the state say which role follows, so the audit alone rebuilds the turns.

A conversation of up to LONG rows is repaired by one task, from rows sorted within partitions.  Longer ones are
cut into blocks: a block's backward pass is a 4 x 4 matrix of costs (minimum and sum in place of sum and product), matrices
compose to the cost to go behind each block, and then blocks are walked side by side.

Nulls: a null role or text is one space (so a null text is blank), a null turn comes first, null conversation ids are one
conversation.  Rows of the same turn are ordered by role and text.  A role is known by its first character; one
that isn't s, u or a can't be kept.  Columns other than the four named are ignored.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import materialise, small_batches

REROLE = INSERT = TRUNCATED = 3
DELETE = 4
INF = 1 << 50
#: White space as the query contract has it.
SPACE = " \t\n\x0b\x0c\r"
#: Grammar states: start, after system, after user, after assistant. By state, the role that an insertion or a new role gives, and the state it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What a role's initial leads to, by state.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
#: A row's code is its role's initial, and one of these.
FINE, CUT, GONE = "f", "t", "d"
#: Rows up to which one task repairs a conversation, and rows of a block of a longer one as a power of two.
LONG, BLOCK = 20_000, 12
END = (0, INF, INF, 0)

Costs = tuple[int, ...]


def _inserted(c: Costs) -> Costs:
    """Costs to go with insertions before the next row; one insertion each is enough but for system and start, which use user's."""
    user = min(c[USER], INSERT + c[ASSISTANT])
    return min(c[START], INSERT + user), min(c[SYSTEM], INSERT + user), user, min(c[ASSISTANT], INSERT + user)


def _before(initial: str, kind: str, c: Costs) -> Costs:
    """Costs to go before a row from those behind it."""
    out = [x + DELETE for x in c]
    if kind != GONE:
        more = TRUNCATED if kind == CUT else 0
        for s in range(4):
            out[s] = min(out[s], c[NEXT[s]] + REROLE + more)
            if (to := KEEP.get((s, initial))) is not None:
                out[s] = min(out[s], c[to] + more)
    return _inserted(tuple(out))


def _walk(codes: list[str], state: int, behind: Costs, last: bool) -> tuple[str, int]:
    """The audit from a state on, and the state it ends in. behind: costs to go behind the codes, with insertions; last: nothing follows."""
    costs = [behind]
    for initial, kind in reversed(codes):
        costs.append(_before(initial, kind, costs[-1]))
    audit, at, n = [], 0, len(codes)
    while at < n or last and costs[0][state]:
        here = costs[n - at]
        left = here[state]
        if at < n:
            initial, kind = codes[at]
            more = TRUNCATED if kind == CUT else 0
            then = costs[n - at - 1]
            if then[state] + DELETE == left:
                audit.append("D")
                at += 1
                continue
        if here[NEXT[state]] + INSERT == left:
            audit.append("I")
            state = NEXT[state]
            continue
        to = KEEP.get((state, initial))
        if to is not None and then[to] + more == left:
            audit.append("K")
            state = to
        else:
            audit.append("R")
            state = NEXT[state]
        at += 1
    return "".join(audit), state


def plan(codes: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    """Cost and audit of a whole conversation; those of few rows are remembered."""
    return _remembered(codes) if len(codes) <= 32 else _planned(codes)


def _planned(codes: tuple[tuple[str, str], ...]) -> tuple[int, str]:
    behind = _inserted(END)
    c = behind
    for initial, kind in reversed(codes):
        c = _before(initial, kind, c)
    return c[START], _walk(list(codes), START, behind, True)[0]


_remembered = lru_cache(1 << 16)(_planned)


def rebuild(audit: str, rows: list[tuple[str, bytes]], state: int = START) -> list[tuple[str, bytes]]:
    """(role, text) of the turns that an audit leaves."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            out.append((GIVEN[state], b""))
        elif edit == "R":
            out.append((GIVEN[state], rows[at][1]))
        elif edit == "K":
            out.append(rows[at])
        if edit == "K":
            state = KEEP[state, rows[at][0][:1]]
        elif edit != "D":
            state = NEXT[state]
        at += edit != "I"
    return out


def _lines(turns: list[tuple[str, bytes]]) -> bytes:
    return b"\n".join(role.encode() + b":" + text for role, text in turns)


def _faults(df: DataFrame) -> DataFrame:
    """With fault: blank, truncated or null, and role and text without nulls."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    df = df.withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" ")))
    return df.withColumn("fault", F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated"))


def _codes(rows) -> tuple[tuple[tuple[str, str], ...], list[int]]:
    """Codes and counts of blank, duplicate, truncated and illegal of rows (role, text, fault)."""
    seen, codes, counts, before = set(), [], [0, 0, 0, 0], None
    for role, text, fault in rows:
        initial = role[:1]
        if fault == "blank":
            kind = GONE
            counts[0] += 1
        elif (role, text) in seen:
            kind = GONE
            counts[1] += 1
        elif fault:
            kind = CUT
            counts[2] += 1
        else:
            kind = FINE
        seen.add((role, text))
        codes.append((initial, kind))
        counts[3] += before is not None and before + initial not in LEGAL
        before = initial
    return tuple(codes), counts


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _short(df: DataFrame, turns: bool) -> DataFrame:
    """Conversations of whole rows (conv_id, turn, role, text, fault, gone), each in one task."""
    kind = dict(df.dtypes)["conv_id"]

    def groups(batches):
        key, rows = object(), []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "gone")), strict=True):
                if row[0] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[0], []
                rows.append(row)
        if rows:
            yield key, rows

    def out(found):
        names = ["conv_id", *(["place", "role", "text"] if turns else [x.split()[0] for x in COUNTS.split(", ")] + ["repaired_sha256"])]
        types = [key_type[0], *([pa.int64(), pa.string(), pa.string()] if turns else [pa.int64()] * 6 + [pa.string()] * 2)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    key_type = []

    def typed(batches):
        for b in batches:
            key_type[:] = [b.column("conv_id").type]
            yield b

    def run(batches):
        found, size = [], 0
        for key, rows in groups(typed(batches)):
            rows = [r for r in rows if not r[5]]
            codes, counts = _codes([r[2:5] for r in rows])
            cost, audit = plan(codes)
            new = rebuild(audit, [(r[2], r[3]) for r in rows])
            if turns:
                found += [(key, k, role, text.decode("utf-8", "replace")) for k, (role, text) in enumerate(new)]
                size += sum(len(t) for _, t in new)
            else:
                known = {r[1] for r in rows if r[1] is not None}
                gaps = max(known) - min(known) + 1 - len(known) if known else 0
                found.append((key, gaps, *counts, cost, audit, hashlib.sha256(_lines(new)).hexdigest()))
                size += len(audit) + 100
            if size > 1 << 20:
                yield out(found)
                found, size = [], 0
        if found:
            yield out(found)

    small_batches(df.sparkSession)
    schema = f"conv_id {kind}, " + ("place long, role string, text string" if turns else f"{COUNTS}, repaired_sha256 string")
    dealt = df.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "turn", "role", F.col("text").cast("binary").alias("text"), "fault", "gone").mapInArrow(run, schema)


def _matrix(codes: list[tuple[str, str]]) -> list[int]:
    """Cost from each state before a block (row) to each state behind it (column), insertions before every row included."""
    columns = []
    for to in range(4):
        c: Costs = tuple(0 if s == to else INF for s in range(4))
        for initial, kind in reversed(codes):
            c = tuple(min(x, INF) for x in _before(initial, kind, c))
        columns.append(c)
    return [columns[to][s] for s in range(4) for to in range(4)]


def _blocks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of long conversations in blocks, stored; and per conversation and block what the walks need, stored too."""
    # Ranges of the whole order, so a conversation of any length is dealt over many tasks; then a row's number is its place in that order.
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = df.where("not gone").drop("gone").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("block", F.shiftright("at", BLOCK)).withColumn("same", F.sha2("text", 256)), "turns")
    first = placed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("same").alias("s")).agg(F.min("at").alias("first"))
    known = placed.drop("text").join(first, (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("role") == F.col("r")) & (F.col("same") == F.col("s")))
    known = known.select("conv_id", "block", "at", "turn", F.substring("role", 1, 1).alias("initial"), F.when(F.col("fault") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("fault")).alias("fault"))
    marks = "concat(initial, case when fault = 'truncated' then 't' when fault is null then 'f' else 'd' end)"
    coded = known.groupBy("conv_id", "block").agg(F.expr(f"transform(array_sort(collect_list(struct(at, {marks} as code))), x -> x.code)").alias("codes"), *(F.expr(f"count_if(fault = '{x}')").alias(x) for x in ("blank", "duplicate", "truncated")))
    kind = dict(df.dtypes)["conv_id"]

    def summed(batches):
        for b in batches:
            split = [[_split(c) for c in x] for x in b.column("codes").to_pylist()]
            illegal = [sum(p[0] + q[0] not in LEGAL for p, q in zip(x, x[1:], strict=False)) for x in split]
            new = {"illegal": pa.array(illegal, pa.int64()), "matrix": pa.array(list(map(_matrix, split)), pa.list_(pa.int64())), "first": pa.array([x[0][0] for x in split], pa.string()), "last": pa.array([x[-1][0] for x in split], pa.string())}
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], names=[*b.schema.names, *new])

    blocks = coded.mapInArrow(summed, f"conv_id {kind}, block long, codes array<string>, blank long, duplicate long, truncated long, illegal long, matrix array<long>, first string, last string")
    blocks = materialise(blocks, "blocks")

    # Costs behind each block: one task a conversation, over a row for every 2 ** BLOCK turns at most.
    def behind(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block", ascending=False)
        c, costs = _inserted(END), []
        for m in p.matrix:
            costs.append(list(c))
            c = tuple(min(int(m[4 * s + t]) + c[t] for t in range(4)) for s in range(4))
        p["behind"], p["cost"] = costs, c[START]
        p["final"] = [True] + [False] * (len(p) - 1)
        return p[["conv_id", "block", "behind", "cost", "final"]]

    costs = blocks.select("conv_id", "block", "matrix").groupBy("conv_id").applyInPandas(behind, f"conv_id {kind}, block long, behind array<long>, cost long, final boolean")
    costs = costs.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "behind", "cost", "final")
    blocks = blocks.join(costs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    @F.pandas_udf("array<struct<audit:string,state:int>>")
    def walks(codes: pd.Series, behind: pd.Series, final: pd.Series) -> pd.Series:
        return pd.Series([[_walk([_split(c) for c in x], s, tuple(map(int, y)), bool(f)) for s in range(4)] for x, y, f in zip(codes, behind, final, strict=True)])

    blocks = materialise(blocks.withColumn("walks", walks("codes", "behind", "final")).drop("codes", "matrix", "behind"), "walks")

    def entered(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        state, entry, before, across = START, [], None, []
        for to, first, last in zip(p.states, p["first"], p["last"], strict=True):
            entry.append(state)
            across.append(int(before is not None and before + first not in LEGAL))
            state, before = int(to[state]), last
        p["entry"], p["across"] = entry, across
        return p[["conv_id", "block", "entry", "across"]]

    entry = blocks.select("conv_id", "block", F.expr("transform(walks, x -> x.state)").alias("states"), "first", "last").groupBy("conv_id").applyInPandas(entered, f"conv_id {kind}, block long, entry int, across long")
    entry = entry.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "across")
    blocks = blocks.join(entry, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    blocks = blocks.withColumn("audit", F.expr("walks[entry].audit")).withColumn("illegal", F.expr("illegal + across")).drop("walks", "first", "last", "across")
    return placed, materialise(blocks, "walked")


def _split(code: str) -> tuple[str, str]:
    """Initial and kind; a role of no characters has the empty initial."""
    return code[:-1], code[-1]


def _long(df: DataFrame, turns: bool) -> DataFrame:
    """As _short, for conversations of any length."""
    kind = dict(df.dtypes)["conv_id"]
    placed, blocks = _blocks(df)
    edits = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "audit", "entry")
    rows = placed.select("conv_id", "block", "at", "role", "text").join(edits, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    def rebuilt(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        old = list(zip(t.column("role").to_pylist(), map(str.encode, t.column("text").to_pylist()), strict=True))
        new = rebuild(t.column("audit")[0].as_py(), old, t.column("entry")[0].as_py())
        same = pa.array(np.zeros(len(new), np.int64))
        cols = [t.column("conv_id").take(same), t.column("block").take(same), pa.array(range(len(new)), pa.int64()), pa.array([r for r, _ in new], pa.string()), pa.array([x.decode() for _, x in new], pa.string())]
        return pa.table(cols, names=["conv_id", "block", "k", "role", "text"])

    new = rows.groupBy("conv_id", "block").applyInArrow(rebuilt, f"conv_id {kind}, block long, k long, role string, text string")
    if turns:
        base = new.groupBy("conv_id", "block").agg(F.max("k").alias("k"))
        before = materialise(base.withColumn("base", F.expr("coalesce(sum(k + 1) over (partition by conv_id order by block rows between unbounded preceding and 1 preceding), 0)")), "bases")
        before = before.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "base")
        return new.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", (F.col("base") + F.col("k")).alias("place"), "role", "text")

    # SHA-256 reads its text in order, so a conversation's repaired text streams through one task, a batch at a time.
    def hashed(batches):
        key, digest, began, found, of = None, None, False, [], None
        for b in batches:
            of = b.column("conv_id").type
            for k, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or k != key:
                    if digest is not None:
                        found.append((key, digest.hexdigest()))
                    key, digest, began = k, hashlib.sha256(), False
                digest.update((b"\n" if began else b"") + role.encode() + b":" + text.encode())
                began = True
        if digest is not None:
            found.append((key, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], of), pa.array([x[1] for x in found])], names=["h", "repaired_sha256"])

    small_batches(df.sparkSession)
    hashes = new.repartition("conv_id").sortWithinPartitions("conv_id", "block", "k").select("conv_id", "role", "text").mapInArrow(hashed, f"h {kind}, repaired_sha256 string")
    told = blocks.groupBy(F.col("conv_id").alias("c")).agg(*(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")), F.first("cost").alias("cost"), F.expr("array_join(transform(array_sort(collect_list(struct(block, audit))), x -> x.audit), '')").alias("audit"))
    gaps = placed.groupBy(F.col("conv_id").alias("g")).agg(F.expr("coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)").alias("gaps"))
    keys = df.select("conv_id").distinct()
    for other, c in ((told, "c"), (gaps, "g"), (hashes, "h")):
        keys = keys.join(other, F.col("conv_id").eqNullSafe(F.col(c)), "left").drop(c)
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return keys.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, gone: Column | None = None, turns: bool = False, long: int = LONG) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; or, with turns, the repaired turns as conv_id, place, role, text.

    rows: conv_id, turn, role, text.  gone: rows that only name their conversation and aren't part of it.
    """
    df = rows.select("conv_id", "turn", "role", "text", (F.lit(False) if gone is None else gone).alias("gone"))
    df = _faults(df)
    sizes = df.groupBy(F.col("conv_id").alias("c")).count().where(F.col("count") > long).drop("count")
    if sizes.isEmpty():
        return _short(df, turns)
    sizes = materialise(sizes, "long")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return _short(df.join(sizes, same, "left_anti"), turns).unionByName(_long(df.join(sizes, same, "left_semi"), turns))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the query contract's damage, and gone: true where the row is dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    df = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), how.alias("how"))
    kept = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).when(F.col("how") != 0, F.col("text")).otherwise("").alias("text")
    df = df.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), kept, (F.col("how") == 0).alias("gone"), F.when(F.col("how") == 3, 2).otherwise(1).alias("n"))
    return df.withColumn("n", F.explode(F.expr("sequence(1, n)"))).drop("n")


def repair_digest(rows: DataFrame) -> DataFrame:
    return repair(damaged(rows), F.col("gone"))
