"""Repair of conversation structure by depth-first branch and bound.

A conversation is a pattern of symbols, two characters a row: the role's initial and the row's fault. search() walks
the edits of a pattern with an explicit stack. Its suffix lower bounds are, by row and by the role written last, the
cost of the rest when the order of audits is left out. A table of the best (cost, audit) reached per row and role cuts
off worse prefixes, the incumbent cuts off whatever cannot beat it, and an empty stack proves it.

Rows are dealt by ranges of (conv_id, turn, role), so one long conversation spreads over tasks. Conversations inside
one task are solved there. Those at a task's edges or of more than BLOCK rows or BYTES of text go on as rows: each
block of BLOCK rows is searched for every role before it and every role after it, a chain over the blocks' costs and
audit ranks picks one way through, and only then are texts and edits joined. Nothing of a long conversation but its
chain (some hundred bytes a block), its audit and the stream of bytes under its digest meets in one task.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_batches, stage, table, tidy

BLOCK, BYTES = 4096, 1 << 22
SPACES = " \t\n\x0b\x0c\r"
#: Roles written last: none, system, user, assistant; what may follow each by insertion or a new role.
LAST, NEXT = "-sua", (2, 2, 3, 2)
FINE, CUT, DROP = "ftd"
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 60
END = 4
OUT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _steps(symbol: str, q: int):
    """Edits of one row after role q, by letter: (letter, cost, role written last)."""
    yield "D", 4, q
    if symbol[1] != DROP:
        own = LAST.find(symbol[0], 1)
        extra = 3 * (symbol[1] == CUT)
        if own > 0 and (NEXT[q] == own or (own == 1 and q == 0)):
            yield "K", extra, own
        yield "R", 3 + extra, NEXT[q]


def _bounds(rows: list[str], goal: int) -> list[list[int]]:
    """Least cost of rows k.. after role q that ends in goal; END is a finished conversation."""
    if goal == END:
        low = [0, 6, 3, 0]
    else:
        low = [0 if q == goal else FAR for q in range(4)]
    out = [low]
    for symbol in reversed(rows):
        one = [min(c + out[-1][to] for _, c, to in _steps(symbol, q)) for q in range(4)]
        out.append([min(one[q], 3 + one[NEXT[q]], 6 + one[NEXT[NEXT[q]]]) for q in range(4)])
    return out[::-1]


def search(pattern: str, start: int = 0, goal: int = END) -> tuple[int, str] | None:
    """The cheapest edits of a pattern after role start, of equal ones the ASCII-least: (cost, audit), None if goal cannot be reached.

    With a goal other than END nothing is inserted behind the last row: that belongs to the block that follows.
    """
    rows = [pattern[i : i + 2] for i in range(0, len(pattern), 2)]
    low, n = _bounds(rows, goal), len(rows)
    if low[0][start] >= FAR:
        return None

    def audit_of(path):
        out = []
        while path:
            out.append(path[1])
            path = path[0]
        return "".join(reversed(out))

    best: tuple[int, tuple | None] | None = None
    seen: dict[tuple[int, int], tuple[int, tuple | None]] = {}
    stack = [(0, start, 0, None)]
    worse = lambda cost, path, than: than is not None and (cost > than[0] or (cost == than[0] and path is not than[1] and audit_of(path) >= audit_of(than[1])))
    while stack:
        k, q, cost, path = stack.pop()
        if best and cost + low[k][q] > best[0]:
            continue
        if worse(cost, path, seen.get((k, q))):
            continue
        seen[k, q] = cost, path
        if k == n and (q == goal or (goal == END and q in (0, 3))):
            if not worse(cost, path, best):
                best = cost, path
            continue
        moves = [(k + 1, to, cost + c, letter) for letter, c, to in _steps(rows[k], q)] if k < n else []
        if k < n or goal == END:
            moves.append((k, NEXT[q], cost + 3, "I"))
        moves = [m for m in moves if m[2] + low[m[0]][m[1]] < FAR]
        moves.sort(key=lambda m: (m[2] + low[m[0]][m[1]], m[3]), reverse=True)
        stack += [(to, role, c, (path, letter)) for to, role, c, letter in moves]
    return best[0], audit_of(best[1])


solve = lru_cache(1 << 16)(search)


def play(audit: str, roles: list[str], q: int = 0):
    """What an audit writes: (row or None, role) for every turn of the repaired conversation."""
    k = 0
    for letter in audit:
        if letter == "I":
            q = NEXT[q]
            yield None, ROLES[q]
        else:
            if letter == "K":
                q = LAST.index(roles[k][0], 1)
                yield k, roles[k]
            elif letter == "R":
                q = NEXT[q]
                yield k, ROLES[q]
            k += 1


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> the rows after damage with their fault but duplicates; a dropped row stays as one that is gone."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", DROP).when(end.isin(".", "!", "?"), FINE).otherwise(CUT)
    return rows.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"), F.explode(F.expr("sequence(1, n)")).alias("copy")).drop("copy")


def _counts(turns: list, roles: list[str]) -> tuple[int, int]:
    """gaps and illegal neighbours of a conversation's rows."""
    known = {t for t in turns if t is not None}
    firsts = [r[:1] for r in roles]
    return (max(known) - min(known) + 1 - len(known)) if known else 0, sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))


def symbols(roles: list[str], faults: list[str]) -> str:
    """The pattern of rows; roles outside of s, u, a (empty ones too) are all alike: they can't be kept."""
    return "".join((r[:1] if r[:1] in ("s", "u", "a") else "-") + f for r, f in zip(roles, faults, strict=True))


def whole(conv, turns: list, roles: list[str], texts: list[str], faults: list[str]) -> tuple:
    """A whole conversation's result: the columns of the query."""
    seen, marks, copies = set(), [], 0
    for key, f in zip(zip(roles, texts, strict=True), faults, strict=True):
        again = f != DROP and key in seen
        copies += again
        seen.add(key)
        marks.append(DROP if again else f)
    cost, audit = solve(symbols(roles, marks))
    lines = "\n".join(f"{r}:{'' if k is None else texts[k]}" for k, r in play(audit, roles))
    gaps, illegal = _counts(turns, roles)
    return conv, gaps, faults.count(DROP), copies, marks.count(CUT), illegal, cost, audit, hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()


def _inside(schema: pa.Schema):
    """The pass over ordered rows: results of conversations inside the task, rows of the others."""
    took = ("conv_id", "turn", "role", "text", "gone", "fault")

    def solved(conv, rows):
        rows = [r for r in rows if not r[3]]
        return whole(conv, *(list(c) for c in (zip(*((t, ro, te, f) for t, ro, te, _, f in rows), strict=True) if rows else ([], [], [], []))))

    def work(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        first, conv, held, size, open_ = True, None, [], 0, False
        out = []

        def passed(rows):
            nonlocal seq
            for t, ro, te, g, f in rows:
                out.append({"conv_id": conv, "whole": False, "part": part, "seq": seq, "turn": t, "role": ro, "text": te, "gone": g, "fault": f})
                seq += 1

        def close(edge):
            nonlocal held, size, open_
            if edge or open_:
                passed(held)
            elif held:
                out.append(dict(zip(schema.names, (*solved(conv, held), True), strict=False)))
            held, size, open_ = [], 0, False

        for batch in part_batches(batches):
            for c, *row in zip(*(batch.column(n).to_pylist() for n in took), strict=True):
                if held or open_:
                    if c != conv:
                        close(first)
                        first = False
                conv = c
                held.append(row)
                size += len(row[2])
                if first or open_ or len(held) > BLOCK or size > BYTES:
                    passed(held)
                    held, size, open_ = [], 0, True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        close(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return work


def _block_table(batches):
    """Blocks' symbols -> cost, audit and its rank for every role before (4) and goal after (5), -1 where there is no way."""
    for batch in batches:
        costs, audits, ranks = [], [], []
        for found in batch.column("pattern").to_pylist():
            ways = [solve(found, q, g) for q in range(4) for g in range(5)]
            place = {a: k for k, a in enumerate(sorted({w[1] for w in ways if w}))}
            costs.append([w[0] if w else -1 for w in ways])
            audits.append([w[1] if w else "" for w in ways])
            ranks.append([place[w[1]] if w else -1 for w in ways])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())), pa.array(ranks, pa.list_(pa.int64()))], [*batch.schema.names, "costs", "audits", "ranks"])


def chain(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The cheapest way through blocks, of equal ones the ASCII-least: its cost and (role before, goal) of every block.

    Audits of prefixes are compared by their order among the four roles after a block and the rank inside the next:
    of two audits over the same rows neither is a beginning of the other.
    """
    now, back = {0: (0, 0)}, []
    for k, (c, r) in enumerate(zip(costs, ranks, strict=True)):
        goals = (END,) if k == len(costs) - 1 else range(4)
        came = {}
        for g in goals:
            ways = [(cost + c[q * 5 + g], order, r[q * 5 + g], q) for q, (cost, order) in now.items() if c[q * 5 + g] >= 0]
            if ways:
                came[g] = min(ways)
        back.append({g: w[3] for g, w in came.items()})
        place = {w: i for i, w in enumerate(sorted({w[1:3] for w in came.values()}))}
        now = {g: (w[0], place[w[1:3]]) for g, w in came.items()}
    way, g = [], END
    for links in reversed(back):
        way.append((links[g], g))
        g = links[g]
    return now[END][0], way[::-1]


def _long(rows: DataFrame, id_type: str) -> DataFrame:
    """Rows of conversations that are spread over tasks or blocks -> their results."""
    live = rows.where("not gone").withColumn("sha", F.sha2("text", 256)).withColumn("blk", F.col("seq") - F.col("seq") % BLOCK)
    at = F.struct("part", "seq")
    firsts = live.groupBy("conv_id", "role", "sha").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1")
    l, r = live.alias("l"), firsts.alias("r")
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.role") == F.col("r.role")) & (F.col("l.sha") == F.col("r.sha"))
    again = (F.col("l.fault") != DROP) & F.coalesce(F.struct("l.part", "l.seq") != F.col("r.at"), F.lit(False))
    live = stage(l.join(r, same, "left").select("l.conv_id", "l.part", "l.seq", "l.blk", "l.turn", "l.role", "l.text", "l.fault", again.alias("again")), "repair-rows")

    first = F.substring("role", 1, 1)
    mark = F.concat(F.when(first.isin("s", "u", "a"), first).otherwise("-"), F.when(F.col("again"), DROP).otherwise(F.col("fault")))
    inside = F.sort_array(F.collect_list(F.struct("seq", mark.alias("mark"), first.alias("first"), "role")))
    blocks = live.groupBy("conv_id", "part", "blk").agg(inside.alias("rows")).select(
        "conv_id", "part", "blk", F.expr("array_join(transform(rows, x -> x.mark), '')").alias("pattern"), F.expr("transform(rows, x -> x.seq)").alias("seqs"), F.expr("transform(rows, x -> x.role)").alias("roles"),
        F.expr("size(filter(sequence(1, size(rows)), i -> i > 1 and concat(rows[i - 2].first, rows[i - 1].first) not in ('su', 'ua', 'au')))").alias("illegal"),
        F.expr("rows[0].first").alias("head"), F.expr("rows[size(rows) - 1].first").alias("tail"),
    )
    shape = f"conv_id {id_type}, part int, blk long, pattern string, seqs array<long>, roles array<string>, illegal int, head string, tail string, costs array<long>, audits array<string>, ranks array<long>"
    blocks = stage(blocks.mapInArrow(tidy(_block_table), shape), "repair-blocks")

    def linked(group: pa.Table) -> pa.Table:
        g = group.sort_by([("part", "ascending"), ("blk", "ascending")])
        cost, way = chain(g["costs"].to_pylist(), g["ranks"].to_pylist())
        heads, tails, n = g["head"].to_pylist(), g["tail"].to_pylist(), len(way)
        between = [int(k > 0 and tails[k - 1] + heads[k] not in ("su", "ua", "au")) for k in range(n)]
        return pa.table({"conv_id": g["conv_id"], "part": g["part"], "blk": g["blk"], "q": pa.array([w[0] for w in way], pa.int32()), "way": pa.array([w[0] * 5 + w[1] for w in way], pa.int32()), "cost": pa.array([cost if k == 0 else 0 for k in range(n)], pa.int64()), "between": pa.array(between, pa.int64())})

    ways = blocks.select("conv_id", "part", "blk", "head", "tail", "costs", "ranks").groupBy("conv_id").applyInArrow(linked, f"conv_id {id_type}, part int, blk long, q int, way int, cost long, between long")
    picked = ways.alias("w").join(blocks.alias("b"), ["part", "blk"]).where(F.col("w.conv_id").eqNullSafe(F.col("b.conv_id")))
    picked = stage(picked.select("b.conv_id", "part", "blk", "seqs", "roles", "q", F.expr("audits[way]").alias("audit"), "cost", (F.col("illegal") + F.col("between")).alias("illegal")), "repair-ways")

    def edits(batches):
        """Lines before each row and the role it gets, null if it is deleted; lines behind the last are a row of their own."""
        for batch in batches:
            out = []
            for part, seqs, roles, q, audit in zip(*(batch.column(c).to_pylist() for c in ("part", "seqs", "roles", "q", "audit")), strict=True):
                lead, k, kept = [], 0, list(play(audit, roles, q))[::-1]
                for letter in audit:
                    got = kept.pop() if letter != "D" else None
                    if letter == "I":
                        lead.append(f"{got[1]}:")
                    else:
                        out.append({"part": part, "seq": seqs[k], "behind": 0, "lead": lead, "to": got and got[1]})
                        lead, k = [], k + 1
                if lead:
                    out.append({"part": part, "seq": seqs[-1], "behind": 1, "lead": lead, "to": None})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("behind", pa.int32()), ("lead", pa.list_(pa.string())), ("to", pa.string())]))

    made = picked.select("part", "seqs", "roles", "q", "audit").mapInArrow(edits, "part int, seq long, behind int, lead array<string>, to string")
    line = F.when(F.col("behind") == 0, F.concat("to", F.lit(":"), "text"))
    lines = live.select("conv_id", "part", "seq", "text").join(made, ["part", "seq"]).select("conv_id", "part", "seq", "behind", F.concat_ws("\n", "lead", line).alias("lines"), (line.isNotNull() | (F.size("lead") > 0)).alias("any")).where("any")

    def digests(batches):
        """One stream of lines a conversation, in order; a conversation may be longer than memory."""
        conv, sha, begun = None, None, False
        for batch in batches:
            out = []
            for c, text in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, begun = c, hashlib.sha256(), True
                else:
                    sha.update(b"\n")
                sha.update(text.encode("utf-8", "surrogatepass"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field("conv_id").type), pa.array([x[1] for x in out])], ["conv_id", "sha"])
            kind = batch.schema.field("conv_id").type
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], ["conv_id", "sha"])

    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "behind").select("conv_id", "lines").mapInArrow(digests, f"conv_id {id_type}, sha string")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    cut = (F.col("fault") == CUT) & ~F.col("again")
    totals = live.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"), count(F.col("fault") == DROP).alias("blank"), count(F.col("again")).alias("duplicate"), count(cut).alias("truncated"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "blk", "audit"))), lambda x: x.audit), "")
    audits = picked.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), joined.alias("audit"))
    out = rows.select("conv_id").distinct()
    for k, part in enumerate((totals, audits, hashes)):
        mine = f"conv_id_{k}"
        out = out.join(part.withColumnRenamed("conv_id", mine), F.col("conv_id").eqNullSafe(F.col(mine)), "left").drop(mine)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(rows: DataFrame) -> DataFrame:
    """conversations -> one row per conv_id: faults after damage, the cheapest edits and the digest of what they make.

    Null roles and texts are one space, null turns come first (in the checksum a null is one space, too), null conv_ids
    are one conversation. Rows of equal turn go by role and text. Roles are told by their first letter; one that is
    neither s, u nor a (an empty one too) can't be kept. Texts of any length are read whole, rows that repeat are
    duplicates, an empty table gives no rows, and other columns are not read.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    hurt = damaged(rows).repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = OUT.format(id=id_type) + ", whole boolean, part int, seq long, turn long, role string, text string, gone boolean, fault string"
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in (f.split() for f in kinds.split(", "))])
    both = stage(hurt.withColumn("turn", F.col("turn").cast("long")).mapInArrow(tidy(_inside(schema)), kinds), "repair")
    results = [f.split()[0] for f in OUT.split(", ")]
    return both.where("whole").select(*results).union(_long(both.where("not whole").select("conv_id", "part", "seq", "turn", "role", "text", "gone", "fault"), id_type).select(*results))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


_CRC = """
crc_table as (select list(c order by i) as crcs from (
  select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i)))"""


def crc_sql(text: str) -> str:
    """crc32 of an ASCII expression, by the table of _CRC."""
    return f"xor(list_reduce([4294967295] || list_transform(range(length({text})), lambda i: ascii(({text})[i + 1])), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


_STEP = {"D": "{{'k': {f}.k + 4, 'a': {f}.a || 'D', 't': {f}.t}}", "K": "{{'k': {f}.k + c, 'a': {f}.a || 'K', 't': {f}.t || [role || ':' || text]}}", "R": "{{'k': {f}.k + c + 3, 'a': {f}.a || 'R', 't': {f}.t || ['{to}:' || text]}}", "I": "{{'k': {f}.k + 3, 'a': {f}.a || 'I', 't': {f}.t || ['{to}:']}}"}
_INSERTS = ", ".join(
    f"list_min([{x}]) as {n}" for n, x in (
        ("i0", "q0"), ("i1", "q1"),
        ("i2", ", ".join(["q2", *(_STEP["I"].format(f=f, to="user") for f in ("q0", "q1", "q3"))])),
        ("i3", ", ".join(["q3", _STEP["I"].format(f="q2", to="assistant")])))
)
_ROW = {
    "q0": ["D i0"], "q1": ["D i1", "K i0 s"],
    "q2": ["D i2", *(f"{e} i{k} u" for k in (0, 1, 3) for e in "KR")], "q3": ["D i3", "K i2 a", "R i2 a"],
}


def _pick(options: list[str]) -> str:
    out = []
    for o in options:
        letter, source, *own = o.split()
        made = _STEP[letter].format(f=source, to={"u": "user", "a": "assistant"}.get(own[0] if own else "", ""))
        test = "not drop_it" + (f" and left(role, 1) = '{own[0]}'" if letter == "K" else "")
        out.append(made if letter == "D" else f"case when {test} then {made} end")
    return f"list_min([{', '.join(out)}])"


SQL_OP11 = rf"""
with recursive {_CRC},
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
kinds as (select conv_id, turn, role, text, {crc_sql("name")} % 20 as kind from raw, crc_table),
hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, kind, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from kinds),
live as (select conv_id, turn, role, text, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as last, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos from hurt where kind <> 0),
marked as (select *, last = '' as is_blank, last <> '' and row_number() over (partition by conv_id, role, text order by pos) > 1 as is_copy, lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) as two from live),
sized as (select *, is_blank or is_copy as drop_it, case when not is_blank and not is_copy and last not in ('.', '!', '?') then 3 else 0 end as c from marked),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (is_blank) as blank, count(*) filter (is_copy) as duplicate, count(*) filter (c = 3) as truncated, count(*) filter (two not in ('su', 'ua', 'au')) as illegal, count(*) as n from sized group by conv_id),
walk as (
  select conv_id, 0::bigint as pos, {{'k': 0, 'a': '', 't': []::varchar[]}} as q0, null::struct(k integer, a varchar, t varchar[]) as q1, null::struct(k integer, a varchar, t varchar[]) as q2, null::struct(k integer, a varchar, t varchar[]) as q3 from counts
  union all
  select conv_id, pos, {", ".join(f"{_pick(o)} as {n}" for n, o in _ROW.items())}
  from (select w.conv_id, s.pos, s.role, s.text, s.c, s.drop_it, {_INSERTS} from walk w join sized s on w.conv_id is not distinct from s.conv_id and s.pos = w.pos + 1)),
done as (select c.*, list_min([q0, q3, {_STEP["I"].format(f="q2", to="assistant")}, {{'k': q1.k + 6, 'a': q1.a || 'II', 't': q1.t || ['user:', 'assistant:']}}]) as best from counts c join walk w on c.conv_id is not distinct from w.conv_id and w.pos = c.n)
select r.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.k, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) r left join done d on r.conv_id is not distinct from d.conv_id
"""
QUERIES = {"op11_repair": op11_repair}
SQL = {"op11_repair": SQL_OP11}
