"""The trie of conversation prefixes, by truncation peeling.

A prefix is known by two hashes of running sums over its turns (128 bits from role, text and position of every turn), so a turn is
read once and texts are not shuffled. Equal conversations are one sequence with copies first. A sequence's tail, the turns that no other
sequence shares, is a chain of nodes with one sequence each; running sums give all its nodes at once. What is left is peeled from the
maximum shared depth: at each depth the sequences whose shared part ends there are merged with the surviving nodes stripped of their
last turn, by prefix, which gives the nodes of that depth with all their aggregates; these are written, stripped and regrouped one
turn higher. Members, children, leaves and savings arrive as sums, so a first turn that a third of all conversations share
costs one row a task. There is one job a shared depth; only its nodes take part.

The ids that end at a node are hashed in order: rows are range-partitioned by id, written out as texts of bounded length a node, and those
are fed to the digest one after the other.

Defined results: null roles and texts are empty ones; rows without a ``conv_id`` take no part; turns are ordered with null first, equal turns
by hashes of role and text. Columns beyond those named are not read. An empty table has no members and so no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.ordered import Scan, ordered_scan
from .common import drop_saved, read_table, save, seeded

HEADS = 9  # op13: lengths of the shared heads, below this number
FAMILY = 5  # op13: conversations that share a head
LOW = (1 << 32) - 1
CHUNK = 65536  # ids written as one text
ROOT = (0, 0)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, size``: turns numbered from 1, with two hashes of role and text and the bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        "conv_id", F.col("turn").isNotNull().cast("int").alias("_given"), F.coalesce("turn", F.lit(0)).alias("_turn"),
        seeded(1, role, text).alias("t1"), seeded(2, role, text).alias("t2"), F.octet_length(text).cast("long").alias("size"),
    )
    numbered = ordered_scan(rows, ["conv_id"], ["_given", "_turn", "t1", "t2", "size"], [Scan("pos", "count")])
    return numbered.select("conv_id", "pos", "t1", "t2", "size")


def with_family_heads(turns: DataFrame, conv_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation ``c`` begins with the first ``h`` turns of ``c - c % 5`` and goes on with its own after ``h``; ``h = crc32(c) % 9``.

    Returns its turns and the table ``conv_id, n`` of all conversations and their lengths.
    """
    head = lambda c: F.crc32(F.encode(c.cast("string"), "UTF-8")) % HEADS
    own_head = head(F.col("conv_id"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = conv_ids.select("conv_id", "n", base.alias("_base"), own_head.alias("_h"))
    bases = conv_ids.select(F.col("conv_id").alias("_b"), F.col("n").alias("_bn")).filter(F.col("_b") % FAMILY == 0)
    known = convs.join(bases, F.col("_base") == F.col("_b"), "left").withColumn("_head", F.least("_h", F.coalesce("_bn", F.lit(0))))
    lengths = known.select("conv_id", (F.col("_head") + F.greatest(F.col("n") - F.col("_h"), F.lit(0))).alias("n"))
    first = turns.filter((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "_of")
    heads = known.select("conv_id", "_base", "_head").join(first, (F.col("_base") == F.col("_of")) & (F.col("pos") <= F.col("_head")))
    heads = heads.select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "size")
    moved = known.select(F.col("conv_id").alias("_c"), "_h", "_head")
    rest = turns.join(moved, (F.col("conv_id") == F.col("_c")) & (F.col("pos") > F.col("_h")))
    rest = rest.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_head")).alias("depth"), "t1", "t2", "size")
    return heads.unionByName(rest), lengths


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, size, total``: keys of the prefix ending in each turn and of the one before it, bytes of the turn and up to it.

    A turn is hashed with its depth; the halves of its hashes are summed along the conversation and hashed again.
    """
    e = {s: seeded(s, "t1", "t2", "depth") for s in (3, 4)}
    halves = [half.alias(f"_e{i}") for i, half in enumerate(x for h in e.values() for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(LOW))))]
    rows = turns.select("conv_id", "depth", "size", *halves)
    scans = [Scan(f"_s{i}", "sum", F.col(f"_e{i}")) for i in range(4)] + [Scan("total", "sum", F.col("size"))]
    sums = ordered_scan(rows, ["conv_id"], ["depth"], scans)
    here = [F.col(f"_s{i}") for i in range(4)]
    before = [F.col(f"_s{i}") - F.col(f"_e{i}") for i in range(4)]
    top = F.col("depth") == 1
    key = lambda s, depth, parts: seeded(s, depth, *parts)
    return sums.select(
        "conv_id", "depth", key(5, F.col("depth"), here).alias("k1"), key(6, F.col("depth"), here).alias("k2"),
        F.when(top, ROOT[0]).otherwise(key(5, F.col("depth") - 1, before)).cast("long").alias("p1"),
        F.when(top, ROOT[1]).otherwise(key(6, F.col("depth") - 1, before)).cast("long").alias("p2"), "size", "total",
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of ``ends(conv_id, k1, k2)``: the ascending ids of a node, joined by commas and hashed."""
    sorted_ids = ends.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    chunk = F.floor(F.monotonically_increasing_id() / CHUNK)  # rises with the id; a chunk lies in one partition
    texts = sorted_ids.withColumn("chunk", chunk).groupBy("k1", "k2", "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, sha.hexdigest()))
                at, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(schema.types)], schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, sha.hexdigest()), schema.types)], schema=schema)

    ordered = texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
    return ordered.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


NODE = ("k1", "k2", "depth", "conv_id", "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _merged(items: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth from sequences that end there and stripped nodes: rows ``k1, k2, conv_id, n_convs, n_children, n_leaves, saved_tokens``."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = items.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), *sums).withColumn("depth", F.lit(depth).cast("long"))
    return nodes.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("long")))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of all prefixes of ``turns(conv_id, depth, t1, t2, size)``; ``lengths(conv_id, n)`` names all conversations, turnless ones too."""
    paths = save(prefixes(turns), "paths")
    zero = F.lit(0).cast("long")
    last = paths.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), "k1", "k2")
    ends = lengths.join(last, (F.col("conv_id") == F.col("_c")) & (F.col("n") == F.col("_d")), "left")
    ends = ends.select("conv_id", "n", F.coalesce("k1", F.lit(ROOT[0])).cast("long").alias("k1"), F.coalesce("k2", F.lit(ROOT[1])).cast("long").alias("k2"))
    ends = save(ends, "ends")
    # Equal conversations become one sequence, named by the smallest id.
    sequences = ends.groupBy("k1", "k2", "n").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sequences = save(sequences.select("rep", "n", "copies"), "sequences")
    own = paths.join(sequences, F.col("conv_id") == F.col("rep"))
    shared = own.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1").select(F.col("k1").alias("_a"), F.col("k2").alias("_b"))
    flagged = own.join(shared, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")), "left")
    flagged = flagged.select("rep", "n", "copies", "depth", "k1", "k2", "p1", "p2", "size", "total", F.col("_a").isNotNull().alias("shared"))
    flagged = save(flagged, "flagged")
    # Where the shared part of a sequence ends, and the bytes up to there and to its end.
    cut = flagged.groupBy("rep").agg(
        F.max(F.when(F.col("shared"), F.col("depth"))).alias("cut"), F.max(F.when(F.col("shared"), F.col("total"))).alias("upto"), F.max("total").alias("all")
    )
    cut = cut.select(F.col("rep").alias("_r"), F.coalesce("cut", zero).alias("cut"), F.coalesce("upto", zero).alias("upto"), "all")
    # The tails: a node for every turn nobody else has.
    tails = flagged.filter(~F.col("shared")).join(cut, F.col("rep") == F.col("_r"))
    tails = tails.select(
        "k1", "k2", "depth", F.col("rep").alias("conv_id"), "p1", "p2", F.col("copies").alias("n_convs"),
        (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("copies") - 1) * (F.col("all") - F.col("total") + F.col("size"))).alias("saved_tokens"), (F.col("depth") - 1 > F.col("cut")).alias("inner"),
    )
    # Every sequence enters at its last shared turn: as an end there, or with its tail as a child.
    entering = sequences.join(cut, F.col("rep") == F.col("_r"), "left").withColumns({"cut": F.coalesce("cut", zero), "upto": F.coalesce("upto", zero)})
    at = flagged.filter("shared").select(F.col("rep").alias("_s"), F.col("depth").alias("_d"), "k1", "k2")
    goes_on = F.col("n") > F.col("cut")
    entering = entering.join(at, (F.col("rep") == F.col("_s")) & (F.col("cut") == F.col("_d")), "left").select(
        F.coalesce("k1", F.lit(ROOT[0])).cast("long").alias("k1"), F.coalesce("k2", F.lit(ROOT[1])).cast("long").alias("k2"), "cut",
        F.col("rep").alias("conv_id"), F.col("copies").alias("n_convs"), goes_on.cast("long").alias("n_children"), goes_on.cast("long").alias("n_leaves"),
        F.when(goes_on, (F.col("copies") - 1) * (F.col("all") - F.col("upto"))).otherwise(zero).alias("saved_tokens"),
    )
    entering = save(entering, "entering")
    # Rows of one depth lie together, so that each round reads its own.
    levels = flagged.filter("shared").select("rep", F.col("depth").alias("_d"), "p1", "p2", "size")
    levels = save(levels.repartitionByRange("_d", "rep").sortWithinPartitions("_d", "rep"), "levels")
    deepest = entering.agg(F.max("cut")).first()[0]
    if deepest is None:
        return _result(lengths.sparkSession.createDataFrame([], entering.schema).selectExpr(*[f"cast(null as long) {c}" for c in (*NODE, "up")]), ends)
    found: list[DataFrame] = []
    stripped = None
    for depth in range(deepest, 0, -1):
        items = entering.filter(F.col("cut") == depth).drop("cut")
        nodes = _merged(items if stripped is None else items.unionByName(stripped), depth)
        here = levels.filter(F.col("_d") == depth)
        nodes = nodes.join(here, F.col("conv_id") == F.col("rep")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
        nodes = save(nodes.select(*NODE), "nodes")
        found.append(nodes)
        stripped = nodes.select(
            F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"
        )
    items = entering.filter("cut = 0").drop("cut")
    root = save(_merged(items if stripped is None else items.unionByName(stripped), 0), "root")
    top = root.first()["conv_id"]
    for frame in (sequences, levels, entering, paths):
        drop_saved(frame)
    # Parents: the root is known, nodes inside a tail have their own sequence, the others look theirs up.
    shared_nodes = found[0] if found else None
    for nodes in found[1:]:
        shared_nodes = shared_nodes.unionByName(nodes)
    tails = tails.withColumn("up", F.when(F.col("depth") == 1, F.lit(top)).when(F.col("inner"), F.col("conv_id"))).drop("inner")
    nodes = tails
    if shared_nodes is not None:
        lower = shared_nodes.withColumn("up", F.when(F.col("depth") == 1, F.lit(top))).unionByName(tails.filter("up is null"))
        parents = shared_nodes.select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), F.col("conv_id").alias("_up"))
        looked = lower.filter("up is null").join(parents, (F.col("p1") == F.col("_a")) & (F.col("p2") == F.col("_b")))
        looked = looked.withColumn("up", F.col("_up")).select(*NODE, "up")
        nodes = looked.unionByName(lower.filter("up is not null")).unionByName(tails.filter("up is not null"))
    first = root.select(*[F.col(c) if c in root.columns else F.lit(0).cast("long").alias(c) for c in NODE], F.lit(None).cast("long").alias("up"))
    return _result(nodes.unionByName(first), ends)


def _result(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    digests = ends_digest(ends.select("conv_id", "k1", "k2")).select(F.col("k1").alias("_a"), F.col("k2").alias("_b"), "ends_sha256")
    joined = nodes.join(digests, (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")), "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are, without heads of other ones."""
    turns = turns_of(conversations)
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return prefix_trie(turns.withColumnRenamed("pos", "depth"), lengths)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, rebuilt so that families of five share their heads."""
    turns = save(turns_of(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    rebuilt, lengths = with_family_heads(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    nodes = prefix_trie(rebuilt, lengths)
    drop_saved(turns)
    return nodes


OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), b)) AS byte_table),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, c: xor(a >> 8, byte_table[(xor(a, c) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
sized AS (SELECT c.*, least(h, coalesce(n, 0)) AS head FROM convs c LEFT JOIN (SELECT conv_id AS b, count(*) AS n FROM t GROUP BY 1) ON b = base),
rebuilt AS (
  SELECT s.conv_id, t.pos AS d, role, text FROM sized s JOIN t ON t.conv_id = base AND pos <= head
  UNION ALL SELECT s.conv_id, pos - h + head, role, text FROM sized s JOIN t ON t.conv_id = s.conv_id AND pos > h),
hashed AS (SELECT conv_id, d, sha256(length(role) || ':' || role || text) AS e, strlen(text)::BIGINT AS size FROM rebuilt),
paths AS (
  SELECT conv_id, d, size, string_agg(e, '/') OVER w AS key FROM hashed WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
lengths AS (SELECT conv_id, max(d) AS n FROM paths GROUP BY 1),
nodes AS (
  SELECT key, d, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE d = n), '') AS ends
  FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY key, d),
up AS (SELECT *, CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE key[:-66] END AS parent FROM nodes),
counted AS (SELECT u.*, coalesce(k, 0) AS n_children FROM up u LEFT JOIN (SELECT parent AS q, count(*) AS k FROM up GROUP BY 1) ON q = key),
below AS (
  SELECT a.key, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
  FROM counted b, unnest(range(0, b.d + 1)) AS r(k) JOIN counted a ON a.key = b.key[:greatest(k * 65 - 1, 0)] GROUP BY a.key)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN below b ON b.key = c.key LEFT JOIN nodes p ON p.key = c.parent
"""
