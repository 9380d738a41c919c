"""Operator 13: the prefix trie of rebuilt conversations by distributed MSD radix partitioning.

Turns become symbols of a dictionary (by a 128-bit key of role and text, so texts aren't shuffled), conversations
become arrays of symbols, and equal ones become one with a number of copies. A round takes the buckets that are too
large for a task: it skips what all sequences of a bucket share (the common prefix of its least and greatest), and
deals the rest by their next symbol. Buckets below `most` symbols, and single sequences, are then finished by a
multikey quicksort in a task, whose partitions are the nodes. Rounds go on with large buckets alone; a round's shared
prefixes are nodes too. Last, counts of leaves and saved tokens go up round by round.

The SHA-256 of the conversations that end at a node takes their ids in order, so one task reads them, as a stream of
ranges of ids; nothing else of a group of equal conversations is ever in one task.

Defined cases: a null role or text is an empty one; rows of a null conv_id belong to no conversation and make none;
equal turns of a conversation are ordered by a hash of role and text, and repeated rows are turns of their own; turns
are ordered null first; conversations without turns are members of the root; a table without conversations has no
nodes; other columns are ignored. Texts of any length are hashed whole. A task holds the symbols of one conversation
(12 bytes a turn), not its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, small_side, written

#: Symbols of a bucket that one task finishes.
LOCAL_SYMBOLS = 65_536
#: Conversations whose ids lie in a range of so many are hashed as one string.
ID_RANGE = 1024
WORD = "[^\\x20\\x09-\\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_NAMES = [f.split()[0] for f in NODE.split(", ")]
NODE_KINDS = [pa.string() if "string" in f else pa.int64() for f in NODE.split(", ")]


def coded(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns' symbols and numbers of words, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    keyed = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("_k"),
        F.xxhash64(F.lit(2), role, text).alias("_l"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("_words"),
    )
    keyed = written(keyed, "keyed-turns")
    dictionary = written(keyed.groupBy("_k", "_l").count().select("_k", "_l", F.monotonically_increasing_id().alias("_symbol")), "dictionary")
    turns = F.sort_array(F.collect_list(F.struct("turn", "_k", "_l", "_symbol", "_words")))
    out = keyed.join(dictionary, ["_k", "_l"]).groupBy("conv_id").agg(turns.alias("_turns"))
    out = written(out.select("conv_id", F.col("_turns._symbol").alias("seq"), F.col("_turns._words").alias("words")), "coded")
    discard(keyed, dictionary)
    return out


def rebuilt(own: DataFrame, family: int = 20, borrowed: int = 4) -> DataFrame:
    """Each conversation with its first h turns taken from the first of its family; h is a crc32 of its id modulo `borrowed`."""
    c = F.col("conv_id")
    kept = borrowed - 1
    heads = own.where(F.pmod(c, F.lit(family)) == 0).select(c.alias("_base"), *(F.slice(x, 1, kept).alias(f"_{x}") for x in ("seq", "words")))
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(borrowed)).cast("int")
    joined = own.select("*", (c - F.pmod(c, F.lit(family))).alias("_base"), h.alias("_h")).join(heads, "_base", "left")

    def of(name: str, kind: str) -> Column:
        head = F.coalesce(F.slice(f"_{name}", F.lit(1), F.col("_h")), F.array().cast(f"array<{kind}>"))
        return F.concat(head, F.slice(name, F.col("_h") + 1, F.size(name))).alias(name)

    return joined.select("conv_id", of("seq", "bigint"), of("words", "int"))


def grouped(sequences: DataFrame) -> DataFrame:
    """One row per different sequence: seq, words, its smallest conv_id, copies, and the SHA-256 of all its ids in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, []
        digest = hashlib.sha256()
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
        names = ["seq", "words", "conv_id", "copies", "ends"]

        def closed() -> tuple:
            return (*state, digest.hexdigest())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

        for batch in batches:
            done = []
            for seq, words, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if seq != now:
                    if now is not None:
                        done.append(closed())
                    now, state, digest = seq, [seq, words, ids[0], 0], hashlib.sha256()
                digest.update((("," if state[3] else "") + ",".join(map(str, ids))).encode())
                state[3] += len(ids)
            yield batch_of(done)
        if now is not None:
            yield batch_of([closed()])

    part = F.floor(F.col("conv_id") / ID_RANGE).alias("_part")
    ranges = sequences.groupBy("seq", "words", part).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ordered = ranges.repartition("seq").sortWithinPartitions("seq", "_part").select("seq", "words", "ids")
    return ordered.mapInArrow(run, "seq array<bigint>, words array<int>, conv_id long, copies long, ends string")


def finished(rows: list[tuple], depth: int) -> list[list]:
    """The nodes of sequences that share their first `depth` symbols, the shared one at `depth` on top.

    rows: (symbols, words, conv_id, copies, ends). A node: conv_id, depth, parent's place in the list (-1: none), n_convs,
    n_children, n_leaves, saved_tokens, ends. Parents stand before their children.
    """
    nodes: list[list] = []
    stack = [(rows, depth - 1, -1)]
    while stack:
        part, at, parent = stack.pop()
        pivot = part[len(part) // 2][0][at]
        less, same, more = [], [], []
        for r in part:
            (same if r[0][at] == pivot else less if r[0][at] < pivot else more).append(r)
        stack += [(x, at, parent) for x in (less, more) if x]
        ended = [r for r in same if len(r[0]) == at + 1]
        longer = [r for r in same if len(r[0]) > at + 1]
        n = sum(r[3] for r in same)
        if parent >= 0:
            nodes[parent][4] += 1
        nodes.append([min(r[2] for r in same), at + 1, parent, n, 0, 0, (n - 1) * same[0][1][at], ended[0][4] if ended else NOTHING])
        if longer:
            stack.append((longer, at + 1, len(nodes) - 1))
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[2] >= 0:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    return nodes


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finishes buckets, whose rows follow each other: round, bucket (its parent's), symbol, depth, and those of `finished`."""

    def made(rows: list[tuple], key: tuple) -> list[tuple]:
        nodes = finished(rows, key[3])
        return [(key[0], key[1], p < 0, c, d, nodes[p][0] if p >= 0 else key[1], *rest) for c, d, p, *rest in nodes]

    kinds = [pa.int32(), pa.int64(), pa.bool_(), *NODE_KINDS]
    names = ["round", "bucket", "top", *NODE_NAMES]
    now, rows = None, []
    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for key, row in zip(zip(*columns[:4]), zip(*columns[4:])):
            if key != now and rows:
                out += made(rows, now)
                rows = []
            now = key
            rows.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made(rows, now)), kinds)], names=names)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes along what the sequences of large buckets share, from bucket, parent, depth, n_convs, path, ends, n_children, n_leaves, below."""
    for batch in batches:
        out = []
        for bucket, parent, depth, n, path, ends, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(len(path) - 1, -1, -1):
                saved += (n - 1) * path[k]
                last = k == len(path) - 1
                out.append((bucket, depth + k, bucket if k else parent, n, children if last else 1, leaves, saved, ends if last else NOTHING))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), NODE_KINDS)], names=NODE_NAMES)


def _shared(active: DataFrame) -> DataFrame:
    """A row per bucket: what its sequences share, and the words of the nodes from its top down to where they part."""
    low = F.min(F.struct("seq", "words", "ends")).alias("_low")
    stats = active.groupBy("bucket").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("copies").alias("n_convs"), low, F.max("seq").alias("_high"))
    shorter = F.least(F.size("_low.seq"), F.size("_high"))
    differs = F.zip_with(F.slice("_low.seq", F.lit(1), shorter), F.slice("_high", F.lit(1), shorter), lambda a, b: a != b)
    parts_at = F.array_position(differs, True)
    stats = stats.withColumn("shared", F.when(parts_at > 0, parts_at - 1).otherwise(shorter).cast("int"))
    words = F.col("_low.words")
    root = F.concat(F.array(F.lit(0)), F.slice(words, F.lit(1), F.col("shared")))
    path = F.when(F.col("depth") == 0, root).otherwise(F.slice(words, F.greatest("depth", F.lit(1)), F.col("shared") - F.col("depth") + 1))
    ends = F.when(F.size("_low.seq") == F.col("shared"), F.col("_low.ends")).otherwise(NOTHING)
    return stats.select("bucket", "parent", "depth", "n_convs", "shared", path.alias("path"), ends.alias("ends"))


def trie(sequences: DataFrame, most: int = LOCAL_SYMBOLS) -> DataFrame:
    """All nodes of conv_id, seq (array of symbols) and words (of each symbol's text)."""
    spark = sequences.sparkSession
    distinct = written(grouped(sequences), "sequences")
    first = distinct.agg(F.min("conv_id")).first()[0]
    if first is None:
        return spark.createDataFrame([], NODE)
    own = ["seq", "words", "conv_id", "copies", "ends"]
    active = distinct.select(F.lit(first).cast("long").alias("bucket"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), *own)
    rounds: list[tuple[DataFrame, DataFrame]] = []
    placed: list[DataFrame] = []
    while True:
        stats = written(_shared(active), "shared")
        parts = active.drop("parent", "depth").join(small_side(stats.select("bucket", "shared")), "bucket").where(F.size("seq") > F.col("shared"))
        parts = parts.select("bucket", F.element_at("seq", F.col("shared") + 1).alias("symbol"), (F.col("shared") + 1).alias("depth"), *own)
        sizes = parts.groupBy("bucket", "symbol").agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("_rows"), F.sum(F.size("seq") - F.col("depth") + 1).alias("_symbols"))
        large = written(sizes.where((F.col("_rows") > 1) & (F.col("_symbols") > most)).select("bucket", "symbol", "top"), "large-buckets")
        placed.append(written(parts.join(small_side(large), ["bucket", "symbol"], "left"), "placed"))
        rounds.append((stats, large))
        if large.isEmpty():
            break
        active = placed[-1].where("top is not null").select(F.col("top").alias("bucket"), F.col("bucket").alias("parent"), "depth", *own)
    key = ["round", "bucket", "symbol", "depth"]
    small = reduce(DataFrame.unionByName, (p.where("top is null").select(F.lit(r).alias("round"), "bucket", "symbol", "depth", *own) for r, p in enumerate(placed)))
    ordered = small.repartition(*key[:3]).sortWithinPartitions(*key[:3])
    local = written(ordered.mapInArrow(_local, f"round int, bucket long, top boolean, {NODE}"), "local-nodes")
    discard(distinct, *placed)

    nodes = [local.select(*NODE_NAMES)]
    over = None
    for r in reversed(range(len(rounds))):
        stats, large = rounds[r]
        tops = local.where(F.col("top") & (F.col("round") == r)).select("bucket", "n_leaves", "saved_tokens")
        if over is not None:
            lower = over.select(F.col("bucket").alias("top"), "n_leaves", F.expr("below + (n_convs - 1) * aggregate(path, 0L, (a, w) -> a + w)").alias("saved_tokens"))
            tops = tops.unionByName(large.join(lower, "top").select("bucket", "n_leaves", "saved_tokens"))
        sums = tops.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        over = stats.drop("shared").join(sums, "bucket", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "below": F.coalesce("below", F.lit(0))})
        over = written(over, "upper")
        nodes.append(over.select("bucket", "parent", "depth", "n_convs", "path", "ends", "n_children", "n_leaves", "below").mapInArrow(_paths, NODE))
    return reduce(DataFrame.unionByName, nodes)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = coded(read(spark, sf_dir, "conversations"))
    return trie(rebuilt(own, family=20, borrowed=4))


OP13_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, r, t) AS s,
    list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc::BIGINT, b::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda a, z: xor((a::BIGINT) >> 1, 3988292384 * ((a::BIGINT) & 1)))) AS crc
  FROM turns GROUP BY conv_id
), cut AS (
  SELECT conv_id, s, xor(crc::BIGINT, 4294967295) % 4 AS h, conv_id - ((conv_id % 20) + 20) % 20 AS base FROM own
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.s, [])[1:c.h], c.s[c.h + 1:]) AS s FROM cut c LEFT JOIN own b ON b.conv_id = c.base
), steps AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM built
), node AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(len(regexp_extract_all(s[1:depth][-1].t, '[^\\x20\\x09-\\x0D]+')), 0) AS saved
  FROM steps GROUP BY 1, 2
), children AS (
  SELECT p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT n.p[1:k.d] AS p, sum(n.saved) AS saved, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM node n LEFT JOIN children c ON c.p = n.p, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS d) k GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.p = n.p LEFT JOIN children c ON c.p = n.p LEFT JOIN node up ON n.depth > 0 AND up.p = n.p[1:n.depth - 1]
"""
