"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Each distinct sequence of a conversation's first d turns is a node; a conversation is a member of all nodes on its
path. A turn is hashed (two 64-bit hashes), a path is the exclusive or of its turns' hashes, each with its place,
so that all paths of all conversations are running totals (``ordered.running``), however long one conversation is.
Two different paths share a node with a chance of about 2^-128 a pair. Afterwards a node is named by its smallest
member and its depth.

Totals of subtrees come from contraction in join rounds. Each round first rakes: leaves are final and give their
totals to their parents. Then it compresses: an inner node with one child left goes if its coin says 1 and its child's
0, and the child is hung on the grandparent with what the node would add. No two neighbours go at once, chains halve
or shrink by a quarter a round, so that rounds grow with the logarithm of the trie's size and not with its depth. The
coin is the round's bit of the depth, which parts a chain evenly, and after these bits a hash. Then the contracted
nodes come back in the opposite order: a node's total is its child's and what was between them. Each round is
written to the shared folder; children are summed before they are shuffled, so that a node with very many of them, such
as the root, makes no large group.

The ids that end at a node are hashed in order: lists of at most RUN are made apart, and their texts are streamed
through one SHA-256, which has no parallel form.

Defined results: turns go by turn (null first), role, text; null roles and texts count as empty; repeated rows are
repeated turns; rows without a conv_id belong to no conversation and are left out; an empty table gives no rows, not even
a root; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.llm.ordered import running
from quakespark.session import discard, materialise

RUN = 4096
DEPTH_BITS = 20
BASE_EVERY, BORROWED = 100, 6
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
VALUES = ("leaves", "saved")


def turn_rows(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))


def placed(turns: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The rows of ``turn_rows`` with ``place`` (from 1 in each conversation), and the facts of their conversation."""
    return running(turns, ["conv"], [F.col("turn"), F.col("role"), F.col("text")], {"place": F.lit(1)}, facts).withColumn("place", F.col("place") + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of conv, place, role, text; all conv), from the rows of ``turn_rows``.

    Conversation c begins with the first h turns of conversation c - c % BASE_EVERY, h = crc32(c) % BORROWED, and goes on with
    its own after its first h. At most BORROWED - 1 rows of a base meet its at most BASE_EVERY conversations; how many
    it has comes with the totals of ``running``, so that no conversation is a join's hot key.
    """
    c = F.col
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    own = sizes.select("conv", (F.crc32(c("conv").cast("string")) % BORROWED).alias("h"), (c("conv") - c("conv") % BASE_EVERY).alias("base"))
    bases = sizes.where(c("conv") % BASE_EVERY == 0).select(c("conv").alias("base"), "size")
    convs = materialise(own.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("got")), "convs")
    rows = placed(turns, convs)
    first = rows.where((c("place") < BORROWED) & (c("conv") % BASE_EVERY == 0)).select(c("conv").alias("base"), "place", "role", "text")
    heads = convs.where("got > 0").join(first, "base").where("place <= got").select("conv", "place", "role", "text")
    tails = rows.where("place > h").select("conv", (c("place") - c("h") + c("got")).alias("place"), "role", "text")
    return heads.unionByName(tails), convs.select("conv")


def nodes_of(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, chars) and ends (conv_id and depth of the node, conv).

    rows: conv, place (from 1, gapless), role, text; convs: conv, once each, also those without rows.
    """
    c, one, zero = F.col, F.lit(1), F.lit(0).cast("long")
    turned = materialise(rows.select("conv", c("place").alias("depth"), F.char_length("text").cast("long").alias("chars"), *(F.xxhash64(F.lit(k), "place", "role", "text").alias(f"t{k}") for k in (1, 2))), "hashed")
    xor = lambda a, b: a.bitwiseXOR(b)
    keyed = running(turned, ["conv"], [c("depth")], {"p1": c("t1"), "p2": c("t2")}, fold=F.bit_xor, join=xor)
    paths = materialise(keyed.select("conv", "depth", "chars", "p1", "p2", xor(c("p1"), c("t1")).alias("k1"), xor(c("p2"), c("t2")).alias("k2")), "paths")
    discard(turned, keyed)
    below = paths.groupBy("depth", "k1", "k2").agg(F.min("conv").alias("conv_id"), F.count(one).alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(one).alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"))
    known = materialise(below.unionByName(root), "nodes")
    parents = known.select((c("depth") + 1).alias("depth"), c("k1").alias("p1"), c("k2").alias("p2"), c("conv_id").alias("parent_conv_id"))
    children = known.where("depth > 0").groupBy((c("depth") - 1).alias("depth"), c("p1").alias("k1"), c("p2").alias("k2")).agg(F.count(one).alias("n_children"))
    nodes = materialise(
        known.join(parents, ["depth", "p1", "p2"], "left").join(children, ["depth", "k1", "k2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "chars"),
        "nodes",
    )
    last = convs.join(paths.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("last")), "conv", "left")
    last = last.select("conv", *(F.coalesce(f"last.{x}", zero).alias(x) for x in ("depth", "k1", "k2")))
    ends = materialise(last.join(known.select("depth", "k1", "k2", "conv_id"), ["depth", "k1", "k2"]).select("conv_id", "depth", "conv"), "ends")
    discard(paths, known)
    return nodes, ends


def end_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes at which conversations end."""
    nth = running(ends, ["conv_id", "depth"], [F.col("conv")], {"nth": F.lit(1)})
    lists = nth.groupBy("conv_id", "depth", F.floor(F.col("nth") / RUN).alias("run")).agg(F.sort_array(F.collect_list("conv")).alias("convs"))
    texts = lists.select("conv_id", "depth", "run", F.array_join(F.col("convs").cast("array<string>"), ",").alias("ids"))
    dealt = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run")
    names = ["conv_id", "depth", "ends_sha256"]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, node, digest = [], None, None
        for b in batches:
            for conv_id, depth, ids in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if node == (conv_id, depth):
                    digest.update(b",")
                else:
                    if node is not None:
                        held.append((*node, digest.hexdigest()))
                    node, digest = (conv_id, depth), hashlib.sha256()
                digest.update(ids.encode())
            if len(held) >= RUN:
                yield batch(held)
                held = []
        if node is not None:
            held.append((*node, digest.hexdigest()))
        if held:
            yield batch(held)

    return dealt.mapInArrow(streamed, "conv_id long, depth long, ends_sha256 string")


def coin(conv: Column, depth: Column, turn: int) -> Column:
    if turn < DEPTH_BITS:
        return F.shiftright(depth, turn) % 2
    return F.pmod(F.xxhash64(F.lit(turn), conv, depth), F.lit(2))


def subtree_totals(nodes: DataFrame, values: tuple[str, ...] = VALUES, max_rounds: int = 400) -> DataFrame:
    """(conv, depth, and the sum of each of ``values`` over the subtree) from nodes of conv, depth, pconv, n (children) and values.

    A parent is (pconv, depth - 1); the root has pconv null. ``a_`` is what a node holds of its own and of those
    that it has taken in, ``u_`` what lies between it and its present parent, whose contribution it thus carries.
    """
    c = F.col
    alive = nodes.select(
        "conv", "depth", "pconv", F.when(c("pconv").isNotNull(), c("depth") - 1).alias("pdepth"), "n",
        *(c(v).alias(f"a_{v}") for v in values), *(F.lit(0).cast("long").alias(f"u_{v}") for v in values),
    )
    rounds = []
    leaf = c("n") == 0
    for turn in range(max_rounds):
        inner = lambda x: F.max(F.when(~leaf, c(x)))  # noqa: E731  of the child, where one is left
        told = alive.where("pconv is not null").groupBy(c("pconv").alias("conv"), c("pdepth").alias("depth")).agg(
            F.count(F.when(~leaf, 1)).alias("left"), inner("conv").alias("kid"), inner("depth").alias("kid_depth"),
            *(inner(f"u_{v}").alias(f"k_{v}") for v in values), *(F.sum(F.when(leaf, c(f"a_{v}") + c(f"u_{v}")).otherwise(0)).alias(f"r_{v}") for v in values),
        )
        going = c("pconv").isNotNull() & (c("left") == 1) & (coin(c("conv"), c("depth"), turn) == 1) & (coin(c("kid"), c("kid_depth"), turn) == 0)
        step = materialise(
            alive.join(told, ["conv", "depth"], "left").select(
                "conv", "depth", "pconv", "pdepth", F.coalesce("left", F.lit(0)).alias("n"), "kid", "kid_depth", *(f"k_{v}" for v in values), *(f"u_{v}" for v in values),
                *((c(f"a_{v}") + F.coalesce(f"r_{v}", F.lit(0))).alias(f"a_{v}") for v in values),
                F.when(leaf, "raked").when(going, "gone").otherwise("left").alias("state"),
            ),
            "step",
        )
        rounds.append(step)
        left, out = step.where("state = 'left'"), step.where("state = 'gone'")
        if left.isEmpty():
            break
        moved = out.select(c("kid").alias("conv"), c("kid_depth").alias("depth"), F.lit(True).alias("moved"), c("pconv").alias("to"), c("pdepth").alias("to_depth"), *((c(f"a_{v}") + c(f"u_{v}")).alias(f"m_{v}") for v in values))
        alive = left.join(moved, ["conv", "depth"], "left").select(
            "conv", "depth", F.when(c("moved"), c("to")).otherwise(c("pconv")).alias("pconv"), F.when(c("moved"), c("to_depth")).otherwise(c("pdepth")).alias("pdepth"), "n",
            *(f"a_{v}" for v in values), *((c(f"u_{v}") + F.coalesce(f"m_{v}", F.lit(0))).alias(f"u_{v}") for v in values),
        )
    else:
        raise RuntimeError(f"contraction did not settle in {max_rounds} rounds")
    # a contracted node's child went in a later round, so going back its total is known
    done = []
    for step in reversed(rounds):
        out = step.where("state = 'gone'")
        if done and not out.isEmpty():
            known = reduce(DataFrame.unionByName, done).select(c("conv").alias("kid"), c("depth").alias("kid_depth"), *values)
            back = out.join(known, ["kid", "kid_depth"]).select("conv", "depth", *((c(v) + c(f"a_{v}") + c(f"k_{v}")).alias(v) for v in values))
            done.append(materialise(back, "back"))
        done.append(step.where("state = 'raked'").select("conv", "depth", *(c(f"a_{v}").alias(v) for v in values)))
    totals = materialise(reduce(DataFrame.unionByName, done), "totals")
    discard(*done, *rounds)
    return totals


def trie_report(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Of every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    c = F.col
    nodes, ends = nodes_of(rows, convs)
    totals = subtree_totals(
        nodes.select(c("conv_id").alias("conv"), "depth", c("parent_conv_id").alias("pconv"), c("n_children").alias("n"), (c("n_children") == 0).cast("long").alias("leaves"), ((c("n_convs") - 1) * c("chars")).alias("saved"))
    )
    hashes = materialise(end_hashes(ends), "ends")
    discard(ends)
    return (
        nodes.join(totals.select(c("conv").alias("conv_id"), "depth", c("leaves").alias("n_leaves"), c("saved").alias("saved_tokens")), ["conv_id", "depth"])
        .join(hashes, ["conv_id", "depth"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    rows = turn_rows(turns)
    return trie_report(placed(rows), rows.select("conv").distinct())


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations that ``rebuilt`` makes, which share beginnings."""
    return trie_report(*rebuilt(turn_rows(turns)))


ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT i.c, k, 0 AS own, role, text FROM i JOIN t ON t.c = base AND k <= h
  UNION ALL SELECT t.c, k, 1, role, text FROM t JOIN i ON i.c = t.c WHERE k > h),
p AS (
  SELECT c, row_number() OVER w AS d, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY own, k)
  UNION ALL SELECT c, 0, 0, '' FROM i),
n AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY d, path),
u AS (SELECT p.c, n.d, n.conv_id, n.n_convs, n.chars FROM p JOIN n ON n.d = p.d AND n.path = p.path),
k AS (SELECT a.conv_id AS c, a.d, b.conv_id AS parent FROM n a JOIN u b ON b.c = a.conv_id AND b.d = a.d - 1),
s AS (
  SELECT a.conv_id AS c, a.d, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.parent = b.conv_id AND k.d = b.d + 1)) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
  FROM n b JOIN u a ON a.c = b.conv_id AND a.d <= b.d GROUP BY ALL),
e AS (SELECT u.conv_id AS c, u.d, sha256(string_agg(u.c::VARCHAR, ',' ORDER BY u.c)) AS hash FROM u JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) m ON m.c = u.c AND m.d = u.d GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, k.parent AS parent_conv_id, n_convs, (SELECT count(*) FROM k q WHERE q.parent = n.conv_id AND q.d = n.d + 1) AS n_children,
  s.n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.hash, '{EMPTY_SHA256}') AS ends_sha256
FROM n LEFT JOIN k ON k.c = n.conv_id AND k.d = n.d JOIN s ON s.c = n.conv_id AND s.d = n.d LEFT JOIN e ON e.c = n.conv_id AND e.d = n.d
"""
