"""Operator 6: documents whose word shingle sets have a Jaccard similarity of at least num / den, by parity sketches.

Every shingle toggles one bit of a long sketch, so the sketches of two sets differ in no more bits than their symmetric
difference. A pair within the threshold with sizes of a band differs in D bits at most. The sketch of a band is cut
into D + 1 + e chunks, so a pair has at least 1 + e equal chunks. A chunk's key is the xor of the hashes of the
shingles that toggled it (the Zobrist hash of its bits): it joins documents of one band by equal chunks. Documents
whose sets are equal were joined before, by the hash of the set, and count as one member of a group.

Chunks without any bit say little, so they are no keys; of 1 + e equal chunks one has bits, unless both documents have
more than e empty chunks: such documents of a band share a key too. e is what a set of the band has of empty chunks,
mean and two deviations, but at least 2, so these are few.

Sets with an equal key form a group. Groups of SMALL members at most are paired. A larger one, a crowd, is not: its
members are compared with a reference, the shingles that most of a few of its members have (any set will do, this one
is near what copies were made from). What two members x, y differ in is what their differences to the reference differ
in; so if they link, these have many shingles in common, at least half of their sizes less D. Sorted alike, with
shingles that the reference lacks first, the first few of each then meet (the prefix rule): these are the keys of the
next round's groups. The member nearest to the reference is the crowd's pivot. Members that link to it, which their
differences tell exactly, are connected already and only look for members that don't, with longer and shorter
prefixes. What are still crowds after ROUNDS rounds, sets that no reference tells apart, go to blocks of BLOCK members, and
all sketches of one are held against all of another in one step, so that only pairs that may be links are made. No link between
different texts is lost. A pair is first held against a sketch of BITS bits: if these differ in more bits than the
sets may in shingles, it is no link. All other pairs are verified on the whole texts.

Defined cases: null texts and texts without words have no set and no link (component_id is their own doc_id); a null
doc_id has a null component_id and doesn't take part in links; repeated rows are equal sets, and rows that share a
doc_id but not the text are sets of their own; an empty table gives no rows; other columns of the input are ignored.
Shingles and sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, released, small_batches, small_side, written
from .components import components
from .shingles import Hashes, mixed, shingle_set

SLACK = 2
#: Smaller sets keep that slack.
LARGE = 48
BITS = 1024
SMALL = 16
ROUNDS = 2
#: Bits of a chunk's key: what is shuffled most. Keys that are equal by chance make a pair to verify, no link.
KEY_BITS = 48
#: Rows of an Arrow batch, as rows hold texts and sets.
BATCH = 1_000
#: Members of a block of a crowd, whose sketches are held against those of another block at once.
BLOCK = 256
#: Members of a crowd that its reference is made of.
SAMPLE = 31
SETS = "doc_id long, th long, n_shingles long, node long, sketch binary"
KEYED = "doc_id long, th long, node long, keys array<long>"


@cache
def bands(num: int, den: int, most: int) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest partner's size, chunks, slack) for each band; chunks is 0 where only equal sets are linked."""
    out, low = [], 1
    while low <= most:
        top = low * den // num  # a band's sizes are low to top
        partner = top * den // num
        apart = (den - num) * (top + partner) // (den + num)
        slack = SLACK
        for _ in range(20):  # more chunks leave more of them empty
            empty = (apart + 1 + slack) * math.exp(-low / (apart + 1 + slack))
            slack = max(slack, min(low, math.ceil(empty + 2 * math.sqrt(empty))) if low >= LARGE else SLACK)
        out.append((low, partner, apart + 1 + slack if apart else 0, slack))
        low = top + 1
    return out


def chunk_keys(shingles: np.ndarray, band: int, chunks: int, slack: int) -> np.ndarray:
    """Keys of the sketch of a set (sorted hashes) in a band."""
    place = ((shingles >> np.uint64(32)) * np.uint64(chunks)) >> np.uint64(32)  # ascending, as the hashes are
    counts = np.bincount(place.astype(np.int64), minlength=chunks)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    bits = np.bitwise_xor.reduceat(shingles, starts)
    keys = mixed(bits + mixed((full + (band << 32)).astype(np.uint64)))
    if chunks - len(full) > slack:
        keys = np.append(keys, mixed(np.array([~band], np.int64).view(np.uint64)))
    return keys >> np.uint64(64 - KEY_BITS)


def parity_bits(shingles: np.ndarray) -> bytes:
    """BITS bits, each toggled by every shingle that falls on it."""
    return np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def sketches(docs: DataFrame, width: int, num: int, den: int, keyed: bool = False) -> DataFrame:
    """doc_id, hash of the text, size, name and parity sketch of each set; or, if keyed, its name and its keys in the bands
    where it may be the smaller or the larger one. Keys are made where they are sent: written, they take more room than texts."""

    def keys_of(s: np.ndarray) -> np.ndarray:
        known = bands(num, den, 1 << max(10, len(s).bit_length()))
        at = bisect_right(known, len(s), key=itemgetter(0)) - 1
        own = [chunk_keys(s, i, *known[i][2:]) for i in (at, at - 1) if i >= 0 and known[i][2] and len(s) <= known[i][1]]
        return np.concatenate(own) if own else s[:0]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sizes, nodes, marks, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, width, hashes)
                nodes.append(node_of(s) if len(s) else None)
                if keyed:
                    keys.append(keys_of(s).view(np.int64) if len(s) else s.view(np.int64))
                else:
                    sizes.append(len(s))
                    marks.append(parity_bits(s) if len(s) else None)
            cols = [batch.column(0), batch.column(1)]
            if keyed:
                cols += [pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            else:
                cols += [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in (KEYED if keyed else SETS).split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(sketch, KEYED if keyed else SETS)


def texts_of(nodes: DataFrame, docs: DataFrame, canon: DataFrame, label: str) -> DataFrame:
    """node and one text for each of the nodes (a written table of distinct ones)."""
    owners = written(canon.join(small_side(nodes), "node", "left_semi").select("node", "doc_id", "th"), "owners")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").join(small_side(owners), ["doc_id", "th"])
    out = written(rows.groupBy("node").agg(F.first("text").alias("text")), label)
    discard(owners)
    return out


def prefixes(own: np.ndarray, n: int, c: int, pivot: tuple[int, int], linked: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles by which a set of size n meets what it may link with, of `own`, its difference from a reference of size
    c: first members that don't link to the pivot, like itself, then members of the other kind. 0 stands for a partner
    without a common shingle. pivot: its size and its difference from the reference, which no member's is under."""
    a, (m, p) = len(own), pivot
    size = np.arange(-(-n * num // den), n * den // num + 1)  # of a partner
    apart = (den - num) * (n + size) // (den + num)  # most shingles it may differ from this set in
    most = (den - num) * (size + m) // (den + num)  # and from the pivot, if it links to it

    def first(partner_linked: bool) -> np.ndarray:
        away = np.maximum.reduce([np.abs(size - c), a - apart, np.full(len(size), p), np.zeros(len(size), int) if partner_linked else most + 1 - p])
        common = -((apart - a - away) // 2)
        if partner_linked:
            common = common[away <= most + p]
        if not len(common):
            return own[:0]
        least = int(common.min())
        return np.append(own, np.uint64(0)) if least <= 0 else own[: max(0, a - least + 1)]

    return (own[:0], first(False)) if linked else (first(False), first(True))


def possible(pairs: DataFrame, canon: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b; a written table) without those whose sketches differ in too many bits."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    marks = written(canon.join(wanted, "node", "left_semi").select("node", "n_shingles", "sketch"), "marks")
    marks = small_side(marks)

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        both = [np.frombuffer(b"".join(v), np.uint64).reshape(len(v), BITS // 64) for v in (x, y)]
        return pd.Series(np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64))

    left = marks.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("x"))
    right = marks.select(F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("y"))
    allowed = (F.col("n") + F.col("m")) * (den - num)
    near = pairs.join(left, "a").join(right, "b").where(F.abs(F.col("n") - F.col("m")) * (den + num) <= allowed)
    return near.where(apart("x", "y") * (den + num) <= allowed).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, canon: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The linked ones of pairs (a, b) of sets, by their sketches and then by their texts."""
    pairs = written(pairs.distinct(), "pairs")
    near = written(possible(pairs, canon, num, den), "possible")
    wanted = written(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "wanted")
    texts = texts_of(wanted, docs, canon, "texts")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            kept, last, t = [], None, None
            for tx, ty in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                s = shingle_set(tx, width, hashes)
                if last != ty:
                    last, t = ty, shingle_set(ty, width, hashes)
                both = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(den * both >= num * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    out = written(near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(judged, "a long, b long"), "links")
    discard(pairs, near, wanted, texts)
    released(docs.sparkSession)
    return out


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The hashes of each row."""
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]], ends[1:-1] - ends[0])


def references(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """key and reference of each crowd (key, node), by sets (node, s): shingles, and the least of them as its name. References
    of one name, which are much alike, then count as one."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node"))
    some = written(crowds.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("key", "node"), "sample")
    some = sets.join(small_side(some), "node")

    def common(group: pd.DataFrame) -> pd.DataFrame:
        s, n = np.unique(np.concatenate([v.view(np.uint64) for v in group["s"]]), return_counts=True)
        c = s[2 * n > len(group)]
        return pd.DataFrame({"key": group["key"].iloc[:1], "ref": [int(c[0].astype(np.int64)) if len(c) else 0], "c": [c.view(np.int64)]})

    return some.groupBy("key").applyInPandas(common, "key long, ref long, c array<long>")


def sets_of(nodes: DataFrame, docs: DataFrame, canon: DataFrame, width: int) -> DataFrame:
    """node and its shingles, s, for each of the nodes (a written table of distinct ones)."""
    texts = texts_of(nodes, docs, canon, "crowd-texts")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    out = written(texts.mapInArrow(shingled, "node long, s array<long>"), "crowd-sets")
    discard(texts)
    return out


def split(crowds: DataFrame, every: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links of members of crowds (key, node; a written table) to their pivots, and the groups (key, node, linked) that
    hold all other pairs that may link. every: a table of sets_of that has all members."""
    # crowds with the same member first are parts of one family and become one
    first = crowds.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("r")).select("key", F.col("r.node").alias("first"))
    crowds = written(crowds.join(small_side(written(first, "firsts")), "key").select(F.col("first").alias("key"), "node").distinct(), "families")
    nodes = written(crowds.select("node").distinct(), "nodes")
    sets = every.join(small_side(nodes), "node", "left_semi")
    refs = written(references(crowds, sets), "references")
    known = written(refs.groupBy("ref").agg(F.first("c").alias("c")), "distinct-references")
    members = written(crowds.join(small_side(written(refs.select("key", "ref"), "keys")), "key").select("ref", "node").distinct(), "crowd-members")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sizes = [], []
            for s, c in zip(arrays(batch.column(2)), arrays(batch.column(3))):
                own.append(np.concatenate([np.setdiff1d(s, c, assume_unique=True), np.setdiff1d(c, s, assume_unique=True)]).view(np.int64))
                sizes.append((len(s), len(c), len(own[-1])))
            n, c, a = (pa.array(list(v), pa.int64()) for v in (zip(*sizes) if sizes else ([], [], [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, c, a, pa.array(own, pa.list_(pa.int64()))], names=["ref", "node", "n", "c", "a", "own"])

    both = sets.join(small_side(members), "node").join(small_side(known), "ref").select("ref", "node", "s", "c")
    diffs = written(both.mapInArrow(differences, "ref long, node long, n long, c long, a long, own array<long>"), "differences")
    nearest = written(diffs.groupBy("ref").agg(F.min(F.struct("a", "node")).alias("p")).select("ref", F.col("p.node").alias("node")), "nearest")
    pivots = diffs.join(small_side(nearest), ["ref", "node"]).select("ref", F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("own").alias("theirs"))
    pivots = written(pivots, "pivots")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            numbers = (batch.column(k).to_pylist() for k in (1, 2, 3, 5, 6))
            for node, n, c, pivot, m, x, y in zip(*numbers, arrays(batch.column(4)), arrays(batch.column(7))):
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                linked = apart * (den + num) <= (n + m) * (den - num)
                same, other = prefixes(x, n, c, (m, len(y)), linked, num, den)
                out.append((node, pivot, linked, same.view(np.int64), other.view(np.int64)))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), k) for v, k in zip(cols, kinds))], names=["ref", "node", "pivot", "linked", "same", "other"])

    joined = diffs.join(small_side(pivots), "ref").select("ref", "node", "n", "c", "own", "pivot", "m", "theirs")
    judged = written(joined.mapInArrow(met, "ref long, node long, pivot long, linked boolean, same array<long>, other array<long>"), "judged")
    found = written(judged.where("linked and node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pivot-links")

    def keyed(by: str, role: int) -> DataFrame:
        return judged.select("ref", "node", "linked", F.explode(by).alias("s")).select(F.xxhash64("ref", "s", F.lit(role)).alias("key"), "node", "linked")

    rows = written(keyed("same", 0).unionByName(keyed("other", 1)), "met")
    discard(nodes, refs, known, members, diffs, nearest, pivots, judged)
    return found, rows


def near_sketches(members: DataFrame, canon: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) within crowds (key, node, linked; a written table), at least one not linked, whose sketches differ in no
    more bits than their sets may. Members go to blocks; two blocks are a row, and a task holds all sketches of one against
    all of the other, so only pairs that may be links become rows."""
    sizes = written(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "crowd-sizes")
    known = canon.join(small_side(written(members.select("node").distinct(), "crowd-nodes")), "node", "left_semi").select("node", "n_shingles", "sketch")
    rows = members.join(small_side(sizes), "key").join(known, "node").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    cells = F.collect_list(F.struct("node", F.col("n_shingles").alias("n"), "linked", "sketch"))
    blocks = written(rows.groupBy("key", "block").agg(cells.alias("m")), "blocks")
    left, right = (blocks.select("key", F.col("block").alias(x), F.col("m").alias(f"m{x}")) for x in "ij")
    both = left.join(right, "key").where("i <= j").select((F.col("i") == F.col("j")).alias("same"), "mi", "mj")

    def unpack(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        node, n, linked, sketch = (cell.values.field(k) for k in ("node", "n", "linked", "sketch"))
        bits = np.frombuffer(b"".join(sketch.to_pylist()), np.uint64).reshape(len(node), -1)
        return node.to_numpy(), n.to_numpy(), linked.to_numpy(zero_copy_only=False), bits

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (a, n, x, p), (b, m, y, q) = unpack(batch.column(1)[k]), unpack(batch.column(2)[k])
                most = (n[:, None] + m[None]) * (den - num)
                apart = np.bitwise_count(p[:, None] ^ q[None]).sum(axis=2, dtype=np.int64)
                may = (apart * (den + num) <= most) & (np.abs(n[:, None] - m[None]) * (den + num) <= most) & ~(x[:, None] & y[None])
                if batch.column(0)[k].as_py():
                    may = np.triu(may | may.T, 1)
                i, j = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], names=["a", "b"])

    out = written(both.repartition("mi", "mj").mapInArrow(held, "a long, b long").where("a != b").distinct(), "near-sketches")
    discard(sizes, blocks)
    return out


def sent_keys(sets: DataFrame, canon: DataFrame) -> DataFrame:
    """key, node and linked (false) of the keyed sets, in place: sets carry all their keys, so these don't travel to leave out copies.
    Up to SMALL rows of one set all send its keys, and what they meet is made distinct; of more, which are few sets, one does."""
    rows = sets.where("node is not null and doc_id is not null")
    counts = canon if "copies" in canon.columns else rows.groupBy("node").agg(F.count("*").alias("copies"))
    many = counts.where(F.col("copies") > SMALL).select("node")
    often = written(canon.join(many, "node", "left_semi").select("node", F.col("doc_id").alias("_d"), F.col("th").alias("_t")), "often")
    if not often.isEmpty():
        rows = rows.join(small_side(often), "node", "left").where("_d is null or (doc_id = _d and th = _t)")
    return rows.select(F.explode("keys").alias("key"), "node", F.lit(False).alias("linked"))


def links(docs: DataFrame, sets: DataFrame, canon: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs of sets that connect all sets which links connect."""
    rows = sent_keys(sketches(docs, width, num, den, keyed=True), canon)
    found, pairs, last, every = None, None, None, None
    for n in range(ROUNDS + 1):
        # keys travel once: what a group is, its different members and their number come from one deal of the rows by key
        group = Window.partitionBy("key")
        met = rows.select("*", F.min("node").over(group).alias("a"), F.max("node").over(group).alias("b"), F.min("linked").over(group).alias("all"))
        met = met.where("a < b and not all").select("key", "node", "linked", "a", "b").distinct()  # members that all link to a pivot are connected
        members = written(met.withColumn("m", F.count("*").over(group)), "members")
        released(docs.sparkSession)  # of keys, most of what is shuffled
        left, right = (members.where(F.col("m").between(3, SMALL)).select("key", F.col("node").alias(x), F.col("linked").alias(f"l{x}")) for x in "ab")
        now = left.join(right, "key").where("a < b and not (la and lb)").select("a", "b").unionByName(members.where("m = 2 and node = a").select("a", "b"))
        now = written(now.distinct(), "candidates")
        pairs = now if pairs is None else pairs.unionByName(now)
        crowds = written(members.where(F.col("m") > SMALL).select("key", "node", "linked"), "crowds")
        discard(members, *([last] if last is not None else []))
        if crowds.isEmpty():
            break
        if n == ROUNDS:
            pairs = pairs.unionByName(near_sketches(crowds, canon, num, den))
            break
        if every is None:  # members of later crowds are some of these
            nodes = written(crowds.select("node").distinct(), "nodes")
            every = sets_of(nodes, docs, canon, width)
            discard(nodes)
        near, rows = split(crowds.select("key", "node").distinct(), every, num, den)
        released(docs.sparkSession)
        found, last = near if found is None else found.unionByName(near), rows
        discard(crowds)
    if every is not None:
        discard(every)
    released(docs.sparkSession)
    near = verified(pairs, docs, canon, width, num, den)
    return near if found is None else found.unionByName(near)


def jaccard_groups(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    with small_batches(docs.sparkSession, BATCH):
        return _groups(docs, width, num, den)


def _groups(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    sets = written(sketches(docs, width, num, den), "sets")
    canon = sets.where("node is not null and doc_id is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "th")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    ).select("node", "at.*", "n_shingles", "sketch", "copies")
    canon = written(canon, "canon")
    label = components(links(docs, sets, canon, width, num, den))
    named = canon.select("node", "doc_id").join(label, "node", "left")
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "label", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    rows = sets.select("doc_id", "n_shingles", "node").join(small_side(written(named, "named")), "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without those near an earlier document: the smallest doc_id of each component stays, once.

    Rows with a null doc_id stay. Of rows that share a doc_id one stays if they are equal in text.
    """
    groups = written(jaccard_groups(docs, width, num, den), "groups")
    gone = written(groups.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small_side(gone), "doc_id", "left_anti")
    twice = written(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    many = kept.join(small_side(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small_side(twice), "doc_id", "left_anti").unionByName(many).select(*docs.columns)


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))
