"""The trie of conversations' prefixes, built as a burst trie.

A turn is named by a 128-bit digest of role and text, so no text is shuffled. Conversations of equal turns become one
sequence with its smallest conv_id. A container is a trie head (a node, named by its smallest conv_id and its depth)
with the suffixes of the sequences under it. A container of more than MEMBERS sequences bursts: its suffixes are dealt
to new heads by their next turn's id, as a group by head and id. The others are dealt to shards, where each is sorted
and swept: neighbours' common lengths give every node that two or more share. A container is swept over the next
TURNS / members turns only; what is still shared behind that is a container of the next round. Below its last shared
node a sequence is alone and its nodes are its own rows: they never enter a container, however long it is.

With the smallest sequence (owner) of every shared node known, all figures of a node are sums over the sequences through
it: a subtree's nodes are those that its sequences own. They are partial sums by (owner, depth), with no walk up the trie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stage, table, tidy
from .repair import _CRC, crc_sql

MEMBERS, TURNS, FAMILY, HEADS = 1 << 12, 1 << 17, 20, 4


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(conv_id, turn, role, text) -> turns(conv_id, part, idx, tid, words, upto) in order, and of every conversation
    the parts it lies in: pieces(conv_id, part, before, n, words_before, words_all, turns_all).

    Rows are dealt by ranges of (conv_id, turn, role): a long conversation spreads over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("sum"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("tid"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    light = light.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "sum").select("conv_id", "tid", "words")

    def number(batches):
        from pyspark import TaskContext

        part, conv, k, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            words = batch.column("words").to_numpy()
            new = np.append(True if conv is None else ids[0] != conv, ids[1:] != ids[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            run = np.cumsum(words)
            idx = np.where(start >= 0, np.arange(len(ids)) - start, np.arange(len(ids)) + k)
            upto = np.where(start >= 0, run - np.where(start > 0, run[start - 1], 0), run + total)
            conv, k, total = ids[-1], int(idx[-1]) + 1, int(upto[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(idx.astype(np.int64)), batch.column("tid"), batch.column("words"), pa.array(upto)], ["conv_id", "part", "idx", "tid", "words", "upto"])

    turns = stage(light.mapInArrow(tidy(number), "conv_id long, part int, idx long, tid binary, words long, upto long"), "trie-turns")
    ends = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    # a conversation's parts: at most as many as there are tasks
    ends = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "w"))).alias("p"))
    total = "aggregate(slice(p, 1, {k}), 0L, (s, x) -> s + x.{f})"
    pieces = ends.select("conv_id", F.expr("transform(sequence(1, size(p)), i -> struct(p[i - 1].part as part, {b} as before, {w} as words_before))".format(b=total.format(k="i - 1", f="n"), w=total.format(k="i - 1", f="w"))).alias("at"), F.expr(total.format(k="size(p)", f="n")).alias("turns_all"), F.expr(total.format(k="size(p)", f="w")).alias("words_all"))
    return turns, stage(pieces.select("conv_id", "turns_all", "words_all", F.inline("at")), "trie-pieces")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations -> convs(c, size), the rebuilt lengths, and turns(c, d, tid, words, tail): turn d of rebuilt c, tail being the words from d to the end."""
    turns, pieces = _placed(rows)
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = pieces.where("before = 0").select("conv_id", "turns_all", "words_all", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), head.alias("h"))
    tops = turns.join(pieces.where(F.col("before") < HEADS - 1), ["conv_id", "part"]).select("conv_id", "tid", "words", (F.col("idx") + F.col("before")).alias("pos"), (F.col("upto") + F.col("words_before")).alias("upto")).where(F.col("pos") < HEADS - 1)
    tops = stage(tops, "trie-tops")
    heads = tops.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), "pos", "tid", "words", F.col("upto").alias("base_upto"))
    first = convs.join(heads, "base").where("pos < h")
    took = first.groupBy("conv_id").agg(F.count("*").alias("b"), F.max("base_upto").alias("head_words"))
    skipped = tops.where(F.col("pos") < head).groupBy("conv_id").agg(F.max("upto").alias("skipped"))
    convs = stage(convs.join(took, "conv_id", "left").join(skipped, "conv_id", "left").na.fill(0, ["b", "head_words", "skipped"]), "trie-convs")
    sizes = convs.select(F.col("conv_id").alias("c"), (F.col("b") + F.greatest(F.col("turns_all") - F.col("h"), F.lit(0))).cast("long").alias("size"))
    # own turns behind the first h; their words are counted from the end
    moved = pieces.join(convs.select("conv_id", (F.col("b") - F.col("h")).alias("shift")), "conv_id").select("conv_id", "part", "before", "words_before", "words_all", "shift")
    pos, upto = F.col("idx") + F.col("before"), F.col("upto") + F.col("words_before")
    own = turns.join(moved, ["conv_id", "part"]).where(pos >= head)
    own = own.select(F.col("conv_id").alias("c"), (pos + F.col("shift") + 1).alias("d"), "tid", "words", (F.col("words_all") - upto + F.col("words")).alias("tail"))
    lead = first.join(convs.select("conv_id", "head_words", "skipped"), "conv_id")
    lead = lead.select(F.col("conv_id").alias("c"), (F.col("pos") + 1).alias("d"), "tid", "words", (F.col("words_all") - F.col("skipped") + F.col("head_words") - F.col("base_upto") + F.col("words")).alias("tail"))
    return sizes, stage(own.union(lead), "trie-rebuilt")


def _digests(batches):
    """Sorted (c, conv_id) -> c, digest of its comma-joined conv_ids, as a stream."""
    now, sha = None, None

    def row(c, sha):
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([sha.hexdigest()])], ["c", "ends"])

    for batch in batches:
        for c, conv in zip(batch.column("c").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if c != now:
                if sha:
                    yield row(now, sha)
                now, sha = c, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(str(conv).encode())
    if sha:
        yield row(now, sha)


def classes(sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations of equal turns as one: c (the smallest), size, m (how many), ends (digest of all their ids)."""
    name = lambda salt: F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws(salt, F.hex("tid"), F.col("d").cast("string"))), 1, 15), 16, 10).cast("long"))
    named = turns.groupBy("c").agg(name(":").alias("x"), name("/").alias("y"))
    all_ = sizes.join(named, "c", "left").na.fill(0, ["x", "y"])
    first = stage(all_.groupBy("size", "x", "y").agg(F.min("c").alias("first"), F.count("*").alias("m")), "trie-classes")
    alone = first.where("m = 1").select(F.col("first").alias("c"), "size", "m", F.sha2(F.col("first").cast("string"), 256).alias("ends"))
    many = first.where("m > 1")
    lists = all_.join(many, ["size", "x", "y"]).select(F.col("first").alias("c"), F.col("c").alias("conv_id")).repartition("c").sortWithinPartitions("c", "conv_id")
    ends = lists.mapInArrow(_digests, "c long, ends string")
    return stage(alone.union(many.select(F.col("first").alias("c"), "size", "m").join(ends, "c")), "trie-sequences")


def sweep(members: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, int, int]]:
    """Suffixes under one head -> (c, step, owner, sequences) for every node, step turns below the head, that two or more share."""
    members = sorted(members, key=lambda m: (m[1], m[0]))
    common = [0]
    for (_, a), (_, b) in zip(members, members[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        common.append(n)
    out, open_ = [], []  # open_[k]: first member of the run that shares k + 1 turns
    for i, n in enumerate([*common[1:], 0]):
        while len(open_) > n:
            step, since = len(open_), open_.pop()
            run = [c for c, _ in members[since : i + 1]]
            owner = min(run)
            out += [(c, step, owner, len(run)) for c in run]
        open_ += [i] * (n - len(open_))
    return out


def _swept(batches):
    """Rows (owner, k, c, d, tid) in order of container, sequence and depth -> shared nodes of whole containers."""
    head, members, out = None, [], []

    def done():
        k = head[1]
        return [(c, k + step, owner, n) for c, step, owner, n in sweep(members)]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["c", "d", "owner", "n"])

    for batch in batches:
        for owner, k, c, tid in zip(*(batch.column(x).to_pylist() for x in ("owner", "k", "c", "tid")), strict=True):
            if (owner, k) != head:
                out += done() if head else []
                head, members = (owner, k), []
            if not members or members[-1][0] != c:
                members.append((c, []))
            members[-1][1].append(tid)
        if out:
            yield batch_of(out)
            out = []
    out += done() if head else []
    if out:
        yield batch_of(out)


def shared(seqs: DataFrame, turns: DataFrame, members: int = MEMBERS, most: int = TURNS) -> list[DataFrame]:
    """Tables of (c, d, owner, n): the nodes that two or more sequences share, with every sequence through them."""
    seqs = seqs.select("c", "size")
    root = seqs.agg(F.min("c").alias("c"), F.count("*").alias("n")).first()
    if not root.n:
        return []
    held = seqs.where("size > 0").select("c", "size", F.lit(root.c).alias("owner"), F.lit(0).cast("long").alias("k"))
    out = []
    while True:
        heads = stage(held.groupBy("owner", "k").agg(F.count("*").alias("s")).where("s > 1"), "trie-heads-held")
        found = heads.agg(F.max("s").alias("top"), F.min("s").alias("low")).first()
        if found.top is None:
            return out
        held = stage(held.join(heads, ["owner", "k"]), "trie-held")
        parts = []
        if found.top > members:
            big = held.where(F.col("s") > members).join(turns.select("c", F.col("d").alias("k1"), "tid"), "c").where("k1 = k + 1")
            nodes = big.groupBy("owner", "k", "tid").agg(F.min("c").alias("low"), F.count("*").alias("n")).where("n > 1")
            parts.append(big.join(nodes, ["owner", "k", "tid"]).select("c", F.col("k1").alias("d"), F.col("low").alias("owner"), "n", "size", (F.col("k") + 1).alias("upto")))
        if found.low <= members:
            reach = F.col("k") + F.floor(F.lit(most) / F.col("s"))
            small = held.where(F.col("s") <= members).withColumn("upto", reach)
            inside = small.join(turns.select("c", "d", "tid"), "c").where("d > k and d <= upto").repartition("owner", "k").sortWithinPartitions("owner", "k", "c", "d")
            swept = inside.select("owner", "k", "c", "tid").mapInArrow(tidy(_swept), "c long, d long, owner long, n long")
            parts.append(swept.join(small.select("c", "size", "upto"), "c").select("c", "d", "owner", "n", "size", "upto"))
        got = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        got = stage(got, "trie-shared")
        out.append(got.select("c", "d", "owner", "n"))
        held = got.where("d = upto and size > d").select("c", "size", "owner", F.col("d").alias("k"))


def nodes(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row for every node of the trie of rebuilt conversations.

    Null turns come first; rows of equal turn go by role and the md5 of their text. Rows without conv_id belong to no
    conversation. A repeated row is a turn of its own. Texts of any length are read whole; other columns are not read;
    an empty table gives no rows. Remainders are those of Spark: of negative ids they are negative.
    """
    sizes, turns = rebuilt(rows)
    seqs = classes(sizes, turns)
    tables = shared(seqs, turns)
    both = tables[0] if tables else seqs.sparkSession.createDataFrame([], "c long, d long, owner long, n long")
    for t in tables[1:]:
        both = both.union(t)
    both = stage(both, "trie-all")
    # by sequence: the last depth that it shares with a smaller one, and with any
    marks = both.groupBy("c").agg(F.max(F.when(F.col("owner") < F.col("c"), F.col("d"))).alias("below"), F.max("d").alias("last"))
    low = seqs.agg(F.min("c")).first()[0]
    seqs = seqs.join(marks, "c", "left").select("c", "size", "m", "ends", F.coalesce("below", F.when(F.col("c") == low, -1).otherwise(0)).alias("below"), (F.coalesce("last", F.lit(0)) < F.col("size")).alias("leaf"))
    # words of the nodes that c owns from its first own turn on
    start = turns.select("c", "d", F.col("tail").alias("own")).join(seqs.where("below >= 0").select("c", (F.col("below") + 1).alias("d")), ["c", "d"]).select("c", "own")
    # a sequence alone in the table is a leaf even without turns
    alone = seqs.agg(F.count("*")).first()[0] == 1
    seqs = stage(seqs.join(start, "c", "left").na.fill(0, ["own"]).withColumn("leaf", F.col("leaf") | F.lit(alone)), "trie-marked")
    tops = turns.where("d = 1").select("c", "tail")
    mine = ("size", "m", "ends", "below", "leaf", "own")
    at_root = seqs.join(tops, "c", "left").select("c", *mine, F.lit(0).cast("long").alias("d"), F.coalesce("tail", F.lit(0)).cast("long").alias("tail"), F.lit(low).cast("long").alias("owner"), F.lit(None).cast("long").alias("parent"))
    up = both.select("c", (F.col("d") + 1).alias("d"), F.col("owner").alias("parent"))
    rest = turns.select("c", "d", "tail").join(both.select("c", "d", "owner"), ["c", "d"], "left").join(up, ["c", "d"], "left").join(seqs, "c")
    parent = F.when(F.col("d") == 1, F.lit(low)).otherwise(F.coalesce("parent", "c"))
    every = at_root.union(rest.select("c", *mine, "d", "tail", F.coalesce("owner", "c").alias("owner"), parent.alias("parent")))
    owned = F.when(F.col("d") > F.col("below"), F.col("tail")).otherwise(F.col("own"))
    child = (F.col("d") < F.col("size")) & (F.col("d") >= F.col("below"))
    out = every.groupBy(F.col("owner").alias("conv_id"), F.col("d").alias("depth")).agg(
        F.min("parent").alias("parent_conv_id"), F.sum("m").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.col("m") * F.col("tail") - owned).alias("saved_tokens"), F.max(F.when(F.col("d") == F.col("size"), F.col("ends"))).alias("ends"),
    )
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "conversations"))


SQL_OP13 = rf"""
with {_CRC},
turns as (select conv_id, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as tid, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
convs as (select conv_id as c, conv_id - conv_id % {FAMILY} as base, {crc_sql("conv_id::varchar")} % {HEADS} as h from (select distinct conv_id from turns), crc_table),
parts as (select c, 0 as which, pos, tid, words from convs join turns on conv_id = base where pos < h union all select c, 1, pos, tid, words from convs join turns on conv_id = c where pos >= h),
rows as (select c, row_number() over (partition by c order by which, pos) as d, tid, words from parts),
paths as (select c, d, words, md5(string_agg(tid, ',') over (partition by c order by d rows unbounded preceding)) as node from rows union all select c, 0, 0, '' from convs),
known as (select node, d as depth, min(c) as conv_id, count(*) as n, any_value(words) as words from paths group by node, d),
sizes as (select c, max(d) as size from paths group by c),
ends as (select p.node, sha256(string_agg(p.c::varchar, ',' order by p.c)) as ends from paths p join sizes s on p.c = s.c and p.d = s.size group by p.node),
links as (select distinct k.node, u.node as up, pk.conv_id as up_id from known k join paths p on p.c = k.conv_id and p.d = k.depth join paths u on u.c = p.c and u.d = p.d - 1 join known pk on pk.node = u.node),
kids as (select up as node, count(*) as n from links group by up),
below as (select distinct a.node as top, b.node from paths a join paths b on a.c = b.c and b.d >= a.d),
sums as (select top, sum((k.n - 1) * k.words) as saved, count(*) filter (kids.n is null) as leaves from below join known k on k.node = below.node left join kids on kids.node = below.node group by top)
select k.conv_id, k.depth::bigint as depth, l.up_id as parent_conv_id, k.n as n_convs, coalesce(kids.n, 0) as n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, coalesce(ends.ends, sha256('')) as ends_sha256
from known k left join links l on l.node = k.node left join kids on kids.node = k.node left join ends on ends.node = k.node join sums s on s.top = k.node
"""
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
SQL = {"op13_prefix_trie": SQL_OP13}
