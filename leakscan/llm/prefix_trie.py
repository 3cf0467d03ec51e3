"""Prefix trie of conversations, with what shared prefixes save.

A node is a distinct sequence of first turns; its owner is the smallest conversation that begins with it.
Prefixes are told apart by a digest for each depth, an exclusive or over hashes of place and turn, and the
minima over equal digests give the owners. If a conversation owns a depth it owns all deeper ones,
so its first owned depth is found by a binary search, all conversations at once: each step looks
up one depth of each. What a conversation owns is a chain; chains hang on nodes of other chains
and form the tree. Sums over subtrees go up the chains by jumps that double, then along each chain.

A conversation is never gathered: turns are sorted by ranges, and sums along a conversation
are taken within blocks of turns and over blocks. Turns leave the first step as digests and lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm.common import drop_saved, join_hot, lean, save

#: Turns of a conversation that are summed up in one window.
SPAN = 4096


def _along(x: DataFrame, key: str, place: str, sums: dict[str, str], back: bool = False) -> DataFrame:
    """x with running aggregates along place within key (from its end if back): name -> an aggregate, such as 'sum(v)' or 'bit_xor(v)', of columns with neutral element 0.

    First within blocks of SPAN places, then over blocks, so that a window holds a block, or one row a block.
    """
    join = {n: "bitwiseXOR" if a.startswith("bit_xor") else "__add__" for n, a in sums.items()}
    x = x.withColumn("_span", F.floor(F.col(place) / SPAN))
    order = F.col("_span").desc() if back else F.col("_span")
    over = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = x.groupBy(key, "_span").agg(*[F.expr(a).alias(n) for n, a in sums.items()])
    spans = spans.select(key, "_span", *[F.coalesce(F.expr(f"{a.split('(')[0]}({n})").over(over), F.lit(0)).alias(f"_{n}") for n, a in sums.items()])
    within = Window.partitionBy(key, "_span").orderBy(F.col(place).desc() if back else F.col(place)).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(spans, [key, "_span"])
    for n, a in sums.items():
        x = x.withColumn(n, getattr(F.expr(a).over(within), join[n])(F.col(f"_{n}")))
    return x.drop("_span", *[f"_{n}" for n in sums])


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as conv_id, place (from 1, by turn, null first), told (digest of role and text), size (UTF-8 bytes of the text).

    Turns of one number are in the order of their digests. Rows without conv_id are left out; null roles and texts are empty."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    told = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    x = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", told.alias("told"), F.octet_length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")
    dealt = save(x.repartitionByRange("conv_id", "turn", "told").withColumn("part", F.spark_partition_id()), "turns", few=False)
    # a conversation's partitions are one after another
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "told"))
    return dealt.withColumn("own", own).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("own")).alias("place"), "told", "size")


def respliced(x: DataFrame, family: int, most: int) -> DataFrame:
    """Conversations (conv_id, place, told, size) with their first turns replaced: the first h ones of conversation conv_id - conv_id % family (all
    if it has fewer, none if it is absent), then the own ones after the first h; h is the crc32 of the decimal conv_id % most.

    Returns conv_id, place, told, size, and a row of place 0 for each conversation; len is the number of its turns.
    """
    x = save(x, "numbered")
    convs = x.groupBy("conv_id").agg(F.max("place").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("first"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    heads = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("m"))
    convs = convs.join(heads, "first", "left").withColumn("taken", F.least(F.coalesce("m", F.lit(0)), "h"))
    convs = save(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    # own turns by blocks of places, so that no conversation is gathered
    spans = x.select("conv_id", F.floor(F.col("place") / SPAN).alias("span")).distinct().join(convs.select("conv_id", "h", "taken", "len"), "conv_id")
    own = x.withColumn("span", F.floor(F.col("place") / SPAN)).join(spans, ["conv_id", "span"]).where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "told", "size", "len")
    head = x.where(F.col("place") < most).withColumnRenamed("conv_id", "first").join(convs.select("first", "conv_id", "h", "len"), "first").where("place <= h")
    head = head.select("conv_id", "place", "told", "size", "len")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("told"), F.lit(0).cast("long").alias("size"), "len")
    return own.unionByName(head).unionByName(none)


def _prefixes(x: DataFrame) -> DataFrame:
    """conv_id, depth, a and b (the digest of the first depth turns), size (of the last one), len."""
    hashed = [F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), "place", "told")) for i in (1, 2)]
    x = x.select("conv_id", F.col("place").alias("depth"), hashed[0].alias("x"), hashed[1].alias("y"), "size", "len")
    return _along(x, "conv_id", "depth", {"a": "bit_xor(x)", "b": "bit_xor(y)"}).select("conv_id", "depth", "a", "b", "size", "len")


_KEY = ["depth", "a", "b"]


def _first_owned(convs: DataFrame, prefixes: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """conv_id, own: the first depth whose node it owns, len + 1 if there is none."""
    owners = nodes.select(*_KEY, "owner", F.col("n_convs").alias("times"))
    x = save(convs.select("conv_id", F.lit(0).cast("long").alias("low"), (F.col("len") + 1).alias("high")), "search")
    done = None
    while True:
        over = x.where("low >= high").select("conv_id", F.col("high").alias("own"))
        done = over if done is None else done.unionByName(over)
        x = x.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        if x.isEmpty():
            return save(done, "owned")
        seen = join_hot(x.join(prefixes.select("conv_id", *_KEY), ["conv_id", "depth"]), owners, _KEY, total)
        mine = F.col("owner") == F.col("conv_id")
        x = save(seen.select("conv_id", F.when(mine, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high")), "search")


def _upward(chains: DataFrame) -> DataFrame:
    """chains (conv_id, up, leaves, saved): the sums over each one and all that hang on it, directly or not.

    After k steps a chain has the sums of those less than 2**k hops below it, and points 2**k hops up."""
    x = save(chains, "chains")
    while True:
        hung = x.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("times")).withColumnRenamed("up", "id")
        hung = save(hung, "hung")
        if hung.isEmpty():
            return x.select("conv_id", "leaves", "saved")
        summed = x.join(hung.select(F.col("id").alias("conv_id"), "l", "s"), "conv_id", "left")
        summed = save(summed.select("conv_id", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "summed")
        jump = hung.join(x.select(F.col("conv_id").alias("id"), F.col("up").alias("next")), "id").select(F.col("id").alias("up"), "next", "times")
        moved = join_hot(summed.where("up IS NOT NULL"), jump, ["up"], x.count()).select("conv_id", F.col("next").alias("up"), "leaves", "saved")
        y = save(moved.unionByName(summed.where("up IS NULL")), "chains")
        for old in (x, hung, summed):
            drop_saved(old)
        x = y


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a sorted partition, joined by commas for each node: owner, depth, part, seq, ids."""
    part, last, ids, seq, out = TaskContext.get().partitionId(), None, [], 0, []
    names = ["owner", "depth", "part", "seq", "ids"]

    def flush() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for b in batches:
        for node in zip(b.column("owner").to_pylist(), b.column("depth").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if node[:2] != last or len(ids) >= 50_000:
                if ids:
                    out.append((*last, part, seq, ",".join(map(str, ids))))
                    seq, ids = seq + 1, []
                last = node[:2]
                if len(out) >= 2000:
                    yield flush()
            ids.append(node[2])
    if ids:
        out.append((*last, part, seq, ",".join(map(str, ids))))
    if out:
        yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a node one after another: their hash, over pieces joined by commas."""
    last, h, out = None, None, []

    def flush() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["owner", "depth", "ends_sha256"])

    for b in batches:
        for owner, depth, ids in zip(b.column("owner").to_pylist(), b.column("depth").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if (owner, depth) == last:
                h.update(b",")
            else:
                if h:
                    out.append((*last, h.hexdigest()))
                    if len(out) >= 10_000:
                        yield flush()
                last, h = (owner, depth), hashlib.sha256()
            h.update(ids.encode())
    if h:
        out.append((*last, h.hexdigest()))
    if out:
        yield flush()


def _ends(members: DataFrame) -> DataFrame:
    """members (owner, depth, conv_id) as owner, depth, ends_sha256: sorted by ranges, joined where they are, then hashed piece after piece."""
    pieces = members.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    pieces = pieces.mapInArrow(lean(_joined), "owner long, depth long, part int, seq int, ids string")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, "owner", "depth").sortWithinPartitions("owner", "depth", "part", "seq").mapInArrow(lean(_hashed), "owner long, depth long, ends_sha256 string")


def trie(x: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, place, told, size, len; a row of place 0 for each): a row for each node.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table has no nodes.
    """
    prefixes = save(_prefixes(x), "prefixes")
    total = prefixes.count()
    least = F.min(F.struct("conv_id", "len")).alias("least")
    nodes = prefixes.groupBy(*_KEY).agg(least, F.count("*").alias("n_convs"), F.max("size").alias("size"))
    nodes = save(nodes.select(*_KEY, F.col("least.conv_id").alias("owner"), F.col("least.len").alias("len"), "n_convs", "size"), "nodes")
    convs = prefixes.where("depth = 0").select("conv_id", "len")
    owned = _first_owned(convs, prefixes, nodes, total)
    # where chains hang: the node before the first owned one
    owners = nodes.select(*_KEY, "owner", F.col("n_convs").alias("times"))
    firsts = convs.join(owned, "conv_id").where("own <= len").select("conv_id", "own")
    above = firsts.where("own > 0").select("conv_id", "own", (F.col("own") - 1).alias("depth")).join(prefixes.select("conv_id", *_KEY), ["conv_id", "depth"])
    hang = save(join_hot(above, owners, _KEY, total).select("conv_id", "own", F.col("owner").alias("up")), "hang")
    kids = hang.groupBy(F.col("up").alias("owner"), (F.col("own") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    x = nodes.select("owner", "depth", "len", "n_convs", "size").join(kids, ["owner", "depth"], "left")
    x = x.withColumn("n_children", F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("len")).cast("long"))
    x = x.select("owner", "depth", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("save"))
    x = save(x, "tree")
    # sums over chains with all that hangs on them, by the node they hang on
    own = x.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("leaf").alias("leaves"), F.sum("save").alias("saved"))
    sums = _upward(own.join(hang.select("conv_id", "up"), "conv_id", "left").select("conv_id", "up", "leaves", "saved"))
    below = hang.join(sums, "conv_id").groupBy(F.col("up").alias("owner"), (F.col("own") - 1).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    x = x.join(below, ["owner", "depth"], "left").withColumn("leaf", F.col("leaf") + F.coalesce("l", F.lit(0))).withColumn("save", F.col("save") + F.coalesce("s", F.lit(0)))
    x = _along(x.drop("l", "s"), "owner", "depth", {"n_leaves": "sum(leaf)", "saved_tokens": "sum(save)"}, back=True)
    ends = prefixes.where("depth = len").select("conv_id", *_KEY)
    ends = _ends(save(join_hot(ends, owners, _KEY, total).select("owner", "depth", "conv_id"), "ends"))
    tops = hang.select(F.col("conv_id").alias("owner"), F.col("own").alias("depth"), "up")
    x = x.join(ends, ["owner", "depth"], "left").join(tops, ["owner", "depth"], "left")
    parent = F.when(F.col("depth") == 0, F.lit(None).cast("long")).otherwise(F.coalesce("up", "owner"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return x.select(F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, family: int | None = None, most: int = 0) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text); with family and most, of respliced ones.

    Rows without conv_id are left out; equal rows are turns of their own. See numbered, respliced and trie."""
    x = numbered(turns)
    return trie(respliced(x, family, most) if family else _whole(x))


def _whole(x: DataFrame) -> DataFrame:
    x = save(x, "numbered")
    lens = x.groupBy("conv_id").agg(F.max("place").alias("len"))
    spans = x.select("conv_id", F.floor(F.col("place") / SPAN).alias("span")).distinct().join(lens, "conv_id")
    own = x.withColumn("span", F.floor(F.col("place") / SPAN)).join(spans, ["conv_id", "span"]).drop("span")
    none = lens.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("told"), F.lit(0).cast("long").alias("size"), "len")
    return own.unionByName(none)
