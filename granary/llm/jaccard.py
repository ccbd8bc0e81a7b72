"""N-gram Jaccard join by a token-group matrix, exact for any threshold, and its components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from granary.llm.common import forget, lists, mixed, shingle_sets, steps, stored, table, texts_of
from granary.llm.graph import components, grown

#: Size of the filter of frequent shingles: so many bits at any size of the corpus (1 MB is broadcast).
BITS = 1 << 23
#: A shingle counts as frequent from so many texts; one task's texts must hold it twice or more for it to be counted.
FREQUENT = 12
#: Shingles that a task counts together.
COUNTED = 2_000_000
#: Members of a group whose token union is opened as one.
GROUP = 32
#: Groups that a list of nodes with a common shingle may have at least, before it is taken apart by further shingles; and
#: shingles of a node that allow for one more: parting a list costs as many rows as its nodes have shingles.
HOT, ROOM = 8, 12
#: The most frequent shingles, at most so many and of so many texts or more: they are never gathered by shingle.
HEAVY, HEAVY_FROM = 1 << 16, 1 << 10
#: Ids that are broadcast at most.
BROADCAST = 1 << 20
#: Orders of shingles whose first one picks a text's group.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)
#: Sizes of the texts of one group lie within this factor, so that its bounds are tight.
SPREAD = 1.02


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with their texts' shingle sets; a slice has a few MB of text, or one text."""
    for batch in batches:
        texts = [t or b"" for t in texts_of(batch.column(1))]
        for a, b in steps(texts):
            yield batch.slice(a, b - a), shingle_sets(texts[a:b], k)


def _flat(arrays: list[np.ndarray]) -> pa.Array:
    return lists(np.concatenate([np.empty(0, np.uint64), *arrays]), np.array([len(x) for x in arrays], np.int64))


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, DataFrame]:
    """A bit filter, indexed by the high bits of a shingle's hash, of shingles in many texts, and the most frequent ones.

    They only order shingles (rare ones first) and route them, and so only bear on speed:
    links are exact whatever they hold. Tasks send shingles that are in two or more of the texts
    they count together. The filter takes the shingles from the least count (a power of two)
    that fills an eighth of it at most; the table has HEAVY rows at most.
    """

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for _, sets in _sets(batches, k):
            kept += sets
            size += sum(map(len, sets))
            if size > COUNTED:
                yield counted(kept)
                kept, size = [], 0
        yield counted(kept)

    found = stored(docs.select("doc_id", "text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    least, total = FREQUENT, 0
    for power, n in sorted((r["p"], r["n"]) for r in found.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())[::-1]:  # at most 64 rows
        total += n
        if total > BITS // 8:
            least = 2 ** (power + 1)
            break
    bit = F.expr(f"shiftrightunsigned(token, {64 - BITS.bit_length() + 1})")
    words = found.where(F.col("n") >= least).groupBy((bit / 32).cast("long").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))).alias("w")).toArrow()  # at most BITS / 32 rows
    out = np.zeros(BITS // 32, np.uint32)
    out[words["at"].to_numpy()] = words["w"].to_numpy().astype(np.uint32)
    heavy = stored(found.where(f"n >= {HEAVY_FROM}").orderBy(F.desc("n"), "token").limit(HEAVY).select("token"), "heavy")
    forget(found)
    return out, heavy


def _is_frequent(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (values >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of n to 2n bits (a power of 2, 64 at least).

    Two sets differ in at least as many shingles as their sketches in bits, so sketches rule
    out pairs without loss. The longer of two sketches folds onto the shorter.
    """
    bits = 1 << max(6, (len(s) - 1).bit_length())
    at = s & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_xor.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def signed(docs: DataFrame, k: int, t: Fraction, bits) -> DataFrame:
    """doc_id, size of its shingle set, digest of the set, prefix, sketch, and the first shingle by each of SEEDS.

    The prefix has the rarest shingles in the one order of all texts (rare ones first, then by
    hash): two sets as similar as ``t`` share one of the first n - ceil(t * n) + 1 of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, every in _sets(batches, k):
            prefixes, firsts, central = [], [], []
            for s in every:
                n = len(s)
                often = _is_frequent(s, bits.value)
                rare = s[~often]
                length = n - math.ceil(t * n) + 1 if n else 0
                prefixes.append(rare[:length] if len(rare) >= length else np.concatenate([rare, s[often][: length - len(rare)]]))
                central.append(len(rare) / n if n else 0.0)
                firsts.append(np.array([mixed(s ^ np.uint64(x)).min() for x in SEEDS] if n else [], np.uint64))
            sizes = pa.array([len(s) for s in every], pa.int64())
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in every], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, digests, pa.array(central, pa.float64()), _flat(prefixes), _flat(firsts), _flat([sketch(s) if len(s) else s for s in every])], ["doc_id", "n", "digest", "rare", "prefix", "firsts", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, rare double, prefix array<long>, firsts array<long>, sketch array<long>")


def with_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and tokens (its shingle set) of ``nodes`` (node, doc_id), and of namesakes: made anew from the texts that are asked for.

    Only the texts of those documents are read into Python: a semi-join, broadcast only up to
    BROADCAST ids. A doc_id can stand in several rows, so callers join by node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, every in _sets(batches, k):
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in every], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, _flat(every)], ["digest", "tokens"])

    asked = nodes.select(F.col("doc_id").alias("_doc"))
    asked = F.broadcast(asked) if nodes.count() <= BROADCAST else asked.distinct()
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("doc_id", "text")
    made = texts.mapInArrow(run, "digest binary, tokens array<long>")
    return made.where("digest is not null").select(F.xxhash64("digest").alias("node"), "tokens")


def differ(a: str, b: str) -> str:
    """SQL for the number of bits in which two sketches differ, after folding the longer one (at most twice as long)."""
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
    return f"aggregate(zip_with({fold.format(a, b)}, {fold.format(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"


class Threshold:
    """What a similarity of ``t`` asks for, in SQL over sizes, places and sketches; all are bounds without loss."""

    def __init__(self, t: Fraction):
        self.up, self.down = t.numerator, t.denominator

    def sizes(self, a: str, b: str) -> str:
        return f"least({a}, {b}) * {self.down} >= greatest({a}, {b}) * {self.up}"

    def sketches(self, a: str, b: str, na: str, nb: str) -> str:
        """Two sets as similar as t differ in at most (1 - t) / (1 + t) of both sizes."""
        return f"{differ(a, b)} * {self.up + self.down} <= ({na} + {nb}) * {self.down - self.up}"

    def reached(self, shared: str, na: str, nb: str) -> str:
        return f"{shared} * {self.down} >= ({na} + {nb} - {shared}) * {self.up}"

    def member(self, room: str, n: str) -> str:
        """Whether the smaller set of a pair can have its first shared shingle where ``room`` shingles are left."""
        return f"{room} * {self.up + self.down} >= 2 * {n} * {self.up}"

    def query(self, room: str, n: str) -> str:
        """The same for the larger set."""
        return f"{room} * {self.down} >= {n} * {self.up}"

    def places(self, q_room: str, qn: str, room: str, least: str) -> str:
        """Whether the places leave query and member the overlap that t asks for, t / (1 + t) of both sizes."""
        smallest = f"({qn} * {self.up} + {self.down - 1}) div {self.down}"
        return f"least({q_room}, {room}) * {self.up + self.down} >= ({qn} + greatest({least}, {smallest})) * {self.up}"


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """The pairs (a, b) of nodes that link, a stored table: sizes and sketches first, then the sets of what they leave."""
    of = nodes.select("node", "doc_id", "n", "sketch")
    both = pairs.join(of.toDF("a", "a_doc", "na", "a_sketch"), "a").join(of.toDF("b", "b_doc", "nb", "b_sketch"), "b")
    left = stored(both.where(t.sizes("na", "nb")).where(t.sketches("a_sketch", "b_sketch", "na", "nb")).select("a", "b", "na", "nb", "a_doc", "b_doc").distinct(), "pairs")
    if left.isEmpty():
        return left.select("a", "b")
    ends = left.select(F.col("a").alias("node"), F.col("a_doc").alias("doc_id")).unionAll(left.select("b", "b_doc"))
    sets = stored(with_sets(docs, ends, k), "sets")  # the texts are read once for both ends
    shared = left.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")).cast("long"))
    out = stored(shared.where(t.reached("shared", "na", "nb")).select("a", "b").distinct(), "links")
    forget(left, sets)
    return out


def starred(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's (column ``token``) nodes with its centre, the least by ``rank``, where their roots differ.

    A comparison for each row of a list, however many rows it has. The centres are a stored
    table, so both sides of the join are exchanged and a hot list is split.
    """
    centre = lists.groupBy("token").agg(F.min(F.struct("rank", "node", "root")).alias("c"), F.min("root").alias("x"), F.max("root").alias("y"))
    centre = stored(centre.where("x <> y").select("token", "c"), "centres")
    out = stored(lists.join(centre, "token").where("root <> c.root").select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct(), "star")
    forget(centre)
    return out


def narrowed(docs: DataFrame, nodes: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Lists (token, node, room) in which each pair of ``nodes`` (node, doc_id, n, root) that links meets; none of more than HOT groups, but for nodes that are alike.

    For nodes whose shingles are frequent: pages of a template, say, share most of theirs, and
    only a few tell them apart. Shingles that the same nodes have are one token with a weight;
    those of one node are missed by any partner. A node stands in the lists of its rarest
    tokens, as far as a partner can miss what comes before. A list of several roots with more
    than HOT groups, and more than its nodes have tokens left, is taken apart in the same way, by
    what its nodes have besides, counted within the list, until none is left. So a node meets no
    more groups in a list than it has shingles. Nodes that may miss all that is left of them
    are as similar as the threshold asks for, near enough, and share a list of their own.

    The HEAVY most frequent tokens, those of templates, stay in arrays of their nodes: a node
    gets rows for what else it has and for the lists that it stands in.
    """
    sets = stored(with_sets(docs, nodes, k).dropDuplicates(["node"]).join(nodes.select("node", "n", "root"), "node").select("node", "n", "root", "tokens"), "hot_sets")
    seen = stored(counted(sets), "seen")
    halves = stored(halved(sets, seen), "halves")
    forget(sets)
    often = "arrays_zip(part, w, tail, after)"
    columns = [F.lit(0).cast("long").alias("token"), "node", "n", "root"]
    # of the most frequent tokens, the ones that a node stands in a list of, and (only if need be) all of them
    heads = halves.select(*columns, F.inline(F.expr(f"filter({often}, x -> {t.query('(x.tail + x.w)', 'n')})")))
    frequent_rest = halves.select(*columns, F.inline(F.expr(often)))
    parts = halves.select(*columns, F.lit(0).cast("long").alias("missed"), F.col("n").alias("total"), F.expr("aggregate(w, 0L, (s, x) -> s + x)").alias("kept"), F.size("part").alias("more"), F.explode("light").alias("part"), F.lit(1).cast("long").alias("w"))
    found, used = [], [halves]
    while True:
        # ``kept`` and ``more``: weight and number of the frequent tokens, which come after all others
        parts = stored(parts, "parts")
        if seen is None:
            seen = parts.groupBy("token", "part").agg(F.count(F.lit(1)).alias("nodes"), F.expr("bit_xor(xxhash64(node))").alias("mark")).where("nodes > 1")
            seen = stored(seen, "seen")
        same = parts.join(seen, ["token", "part"]).groupBy("token", "node", "n", "root", "missed", "total", "kept", "more", "nodes", "mark").agg(F.sum("w").alias("w"))
        order = Window.partitionBy("token", "node").orderBy("nodes", "mark")
        placed = same.withColumn("tail", F.expr("kept - w") + F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        placed = placed.withColumn("after", F.col("more") + F.count(F.lit(1)).over(Window.partitionBy("token", "node")) - F.row_number().over(order))
        # what comes before a token, or is in no other node, is missed
        placed = placed.select("token", "node", "n", "root", F.xxhash64("nodes", "mark").alias("part"), "w", "tail", F.col("after").cast("long").alias("after"), F.expr("n - missed - total + tail + w").alias("room"))
        placed = stored(placed, "placed")
        below = placed.where(t.query("room", "n"))
        if heads is not None:
            below = below.unionByName(heads.withColumn("room", F.expr("tail + w")))
        below = stored(below.withColumn("list", F.xxhash64("token", "part")), "below")
        level = F.floor(F.log("n") / math.log(SPREAD)).cast("int").alias("level")
        groups = below.groupBy("list", "root", level).agg(F.count(F.lit(1)).alias("rows"), F.sum("after").alias("after"), F.max(F.expr(t.member("room", "n"))).alias("open"))
        lists = groups.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count_if("open").alias("groups"), F.sum("rows").alias("rows"), F.sum("after").alias("after"))
        lists = stored(lists.where("x <> y and groups > 0").select("list", F.expr(f"groups > {HOT} and groups * rows > after").alias("hot")), "lists")
        listed = stored(below.select("list", "node", "n", "root", "room", "tail", F.col("token").alias("above")).join(lists, "list"), "listed")
        found.append(stored(listed.where("not hot").select(F.col("list").alias("token"), "node", "room"), "narrow"))
        hot = listed.where("hot").drop("hot")
        forget(parts, seen, lists, below)
        used += [placed, listed]
        if hot.isEmpty():
            break
        # a node that may miss the rest of its tokens
        ended = hot.withColumn("room", F.expr("room - tail")).where(t.query("room", "n"))
        found.append(stored(ended.select(F.xxhash64("list", F.lit("end")).alias("token"), "node", "room"), "narrow"))
        rest = placed.select("token", "node", "part", "w", "tail")
        if heads is not None:
            rest = rest.unionByName(frequent_rest.select("token", "node", "part", "w", "tail").join(hot.select("node").distinct(), "node", "left_semi"))
        rest = rest.select(F.col("token").alias("above"), "node", "part", F.col("w").alias("pw"), F.col("tail").alias("at"))
        parts = hot.join(rest, ["above", "node"]).where("at < tail").select(F.col("list").alias("token"), "node", "n", "root", F.expr("n - room").alias("missed"), F.col("tail").alias("total"), F.lit(0).cast("long").alias("kept"), F.lit(0).alias("more"), "part", F.col("pw").alias("w"))
        seen = heads = None
    out = stored(docs.sparkSession.read.schema("token long, node long, room long").parquet(*(x._granary_path for x in found)), "narrowed")
    forget(*found, *used)
    return out


def counted(sets: DataFrame) -> DataFrame:
    """token (0), part, nodes and mark (of the nodes that have it) of each shingle that two or more of ``sets`` (node, n, root, tokens) have; tasks count their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def sums() -> pa.RecordBatch:
            parts = np.concatenate([np.empty(0, np.int64), *(p for p, _ in kept)])
            marks = np.concatenate([np.empty(0, np.uint64), *(m for _, m in kept)])
            order = np.argsort(parts, kind="stable")
            values, at, n = np.unique(parts[order], return_index=True, return_counts=True)
            marks = np.bitwise_xor.reduceat(marks[order], at) if len(at) else marks
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64)), pa.array(marks.view(np.int64))], ["part", "nodes", "mark"])

        for batch in batches:
            tokens = batch.column(1)
            lengths = np.diff(tokens.offsets.to_numpy())
            kept.append((tokens.flatten().to_numpy(), np.repeat(mixed(batch.column(0).to_numpy().view(np.uint64)), lengths)))
            size += int(lengths.sum())
            if size > COUNTED:
                yield sums()
                kept, size = [], 0
        yield sums()

    made = sets.select("node", "tokens").mapInArrow(run, "part long, nodes long, mark long")
    found = made.groupBy("part").agg(F.sum("nodes").alias("nodes"), F.expr("bit_xor(mark)").alias("mark")).where("nodes > 1")
    return found.select(F.lit(0).cast("long").alias("token"), "part", "nodes", "mark")


def halved(sets: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of ``sets`` with their shingles taken apart: ``light`` ones, and the HEAVY most frequent ones of ``seen`` in the order of their counts.

    The latter are arrays: ``part`` (one for shingles that the same nodes have), ``w`` (its shingles), ``tail``
    and ``after`` (shingles and parts that come after it). The shingles of a template are never gathered
    by shingle, nor a row each.
    """
    heavy = seen.orderBy(F.desc("nodes"), "part").limit(HEAVY).select("part", "nodes", "mark", F.xxhash64("nodes", "mark", F.lit("frequent")).alias("id")).toArrow()  # at most HEAVY rows
    keys, counts, marks, ids = (heavy[x].to_numpy() for x in ("part", "nodes", "mark", "id"))
    order = np.lexsort((marks, counts))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(counts[order]) != 0) | (marks[order][1:] != marks[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    by = np.argsort(keys)
    shared = sets.sparkSession.sparkContext.broadcast((keys[by], rank[by], ids[order][new]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank, ids = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            light, part, w, tail, after = [], [], [], [], []
            tokens = batch.column(3)
            flat, ends = tokens.flatten().to_numpy(), np.cumsum(np.diff(tokens.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            often = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            for values, places, is_often in zip(*(np.split(x, ends[:-1]) for x in (flat, at, often))):
                groups, n = np.unique(rank[places[is_often]], return_counts=True)
                light.append(values[~is_often])
                part.append(ids[groups])
                w.append(n.astype(np.int64))
                tail.append(n.sum() - np.cumsum(n))
                after.append(np.arange(len(n), dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(_flat([x.view(np.uint64) for x in y]) for y in (light, part, w, tail, after))], ["node", "n", "root", "light", "part", "w", "tail", "after"])

    return sets.mapInArrow(run, "node long, n long, root long, light array<long>, part array<long>, w array<long>, tail array<long>, after array<long>")


def linked(docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (see ``jaccard_join``), its node and its component's root (null without shingles)."""
    t = Threshold(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits, heavy = frequent(docs, k)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = stored(signed(docs, k, threshold, shared), "signed")

    # equal sets are one node
    node = F.xxhash64("digest").alias("node")
    nodes = stored(rows.where("n > 0").groupBy(node).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("prefix").alias("prefix"), F.first("firsts").alias("firsts"), F.first("sketch").alias("sketch")), "nodes")

    # nodes with the same first shingle, around the one with the fewest rare shingles
    firsts = nodes.select("node", F.col("node").alias("root"), F.col("rare").alias("rank"), F.posexplode("firsts").alias("seed", "first"))
    star = starred(firsts.select(F.xxhash64("seed", "first").alias("token"), "node", "root", "rank"))
    edges = verified(docs, nodes, star, k, t)
    roots = components(edges)

    # the same for nodes that share a shingle of their prefixes, then for what hot lists of these are narrowed to
    root = F.coalesce("root", F.col("node")).alias("root")

    def joined(lists: DataFrame) -> DataFrame:
        """The components once each list's nodes are linked with their centre."""
        again = starred(lists.join(roots, "node", "left").select("token", "node", root, F.xxhash64("node").alias("rank")))
        edges = verified(docs, nodes, again, k, t)
        out = grown(roots, edges)
        forget(again, edges)
        return out

    forget(star, edges)
    cells = shared_cells(nodes, roots, heavy)
    roots = joined(cells)
    lists, more = narrow_lists(docs, nodes, roots, cells, k, t)
    if more is not None:
        roots = joined(more)
        lists = stored(lists.unionAll(more), "lists")
        forget(more)

    # token-group matrix over the lists. A group: linked nodes of about the same size, so that
    # the bounds of its members' sizes and places are tight
    level = F.floor(F.log(F.col("n")) / math.log(SPREAD)).cast("int").alias("level")
    placed = nodes.join(roots, "node", "left").select("node", "doc_id", "n", root, level, "sketch")
    opened = opened_groups(lists.join(placed.drop("doc_id", "sketch"), "node"), t)

    # groups of one node are compared by their sketches
    sizes = placed.groupBy("root", "level").agg(F.count(F.lit(1)).alias("size"), F.first("sketch").alias("g_sketch"), F.first("n").alias("g_n"))
    likely = opened.join(sizes, ["root", "level"]).join(nodes.select("node", "doc_id", "n", "sketch"), "node")
    alike = F.expr(t.sizes("n", "g_n")) & F.expr(t.sketches("sketch", "g_sketch", "n", "g_n"))
    queries = stored(likely.where((F.col("size") > 1) | alike).select("node", "doc_id", "n", "root", "level", "size"), "queries")

    # the groups that queries ask for, in parts of a bounded number of members with their token union
    asked = queries.select("root", "level", "size").distinct()
    members = placed.drop("sketch").join(asked, ["root", "level"]).select("node", "doc_id", "n", "root", "level", F.pmod(F.xxhash64(F.lit(1), "node"), F.ceil(F.col("size") / GROUP)).alias("part"))
    members = stored(members, "members")
    sets = stored(with_sets(docs, members.select("node", "doc_id").unionAll(queries.select("node", "doc_id")), k), "sets")
    unions = members.join(sets, "node").groupBy("root", "level", "part").agg(F.collect_list(F.struct("node", "n", "tokens")).alias("members"))
    unions = unions.withColumn("union", F.when(F.size("members") == 1, F.col("members")[0]["tokens"]).otherwise(F.array_distinct(F.flatten(F.col("members.tokens")))))
    # a member as similar as t shares t of the query's shingles, and the member's are all in the union
    tested = queries.drop("size").join(sets, "node").join(unions, ["root", "level"])
    qualified = tested.withColumn("room", F.size(F.array_intersect("tokens", "union")).cast("long")).where(t.query("room", "n"))
    pairs = qualified.select("node", "n", "tokens", F.explode("members").alias("m")).withColumn("shared", F.size(F.array_intersect("tokens", "m.tokens")).cast("long"))
    edges = stored(pairs.where(t.reached("shared", "n", "m.n")).select(F.col("node").alias("a"), F.col("m.node").alias("b")), "links")
    every = grown(roots, edges)

    # the smallest doc_id of each component, and back to all rows
    label = nodes.join(every, "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = nodes.select("node", "doc_id").join(every, "node", "left").join(label, "root", "left").select("node", root, F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), node).join(named, "node").select("doc_id", "n_shingles", "component_id", "node", "root")
    out = stored(out.unionAll(rows.where("n = 0").select("doc_id", "n", "doc_id", *(F.lit(None).cast("long") for _ in range(2)))), "linked")
    forget(rows, nodes, heavy, cells, sets, lists, opened, queries, members, every, edges)
    return out


def shared_cells(nodes: DataFrame, roots: DataFrame, heavy: DataFrame) -> DataFrame:
    """Lists (token, node, n, room) of the prefixes' shingles that nodes of several roots share; a stored table.

    ``room`` is what a shingle's place leaves of the node. ``heavy`` shingles (a table of
    bounded size) aren't gathered by shingle: whether they have several roots is summed up with
    partial sums, and goes back to the rows as a broadcast.
    """
    root = F.coalesce("root", F.col("node")).alias("root")
    cells = nodes.join(roots, "node", "left").select("node", root, "n", F.posexplode("prefix").alias("at", "token"))
    several = lambda rows: rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    busy = cells.join(F.broadcast(heavy), "token")
    light = cells.join(F.broadcast(heavy), "token", "left_anti").repartition("token")  # one exchange for the two uses
    found = light.join(several(light), "token").unionByName(busy.join(F.broadcast(several(busy)), "token"))
    return stored(found.select("token", "node", "n", (F.col("n") - F.col("at")).alias("room")), "cells")


def narrow_lists(docs: DataFrame, nodes: DataFrame, roots: DataFrame, cells: DataFrame, k: int, t: Threshold) -> tuple[DataFrame, DataFrame | None]:
    """The lists (token, node, room) that are left as they are, and what the hot ones are narrowed to (None: there are none).

    Hot is a list with several roots that has more groups with a place for the smaller set of a pair than HOT, and than its nodes' shingles allow for.
    """
    root = F.coalesce("root", F.col("node")).alias("root")
    level = F.floor(F.log(F.col("n")) / math.log(SPREAD)).cast("int").alias("level")
    groups = cells.where(t.member("room", "n")).join(roots, "node", "left").groupBy("token", root, level).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    wide = groups.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    wide = stored(wide.where(f"x <> y and groups > {HOT} and groups * rows * {ROOM} > shingles").select("token"), "wide")
    if wide.isEmpty():
        forget(wide)
        return cells.select("token", "node", "room"), None
    hot = cells.join(wide, "token").select("node").distinct()
    hot = stored(nodes.select("node", "doc_id", "n").join(hot, "node").join(roots, "node", "left").select("node", "doc_id", "n", root), "hot")
    more = narrowed(docs, hot, k, t)
    rest = stored(cells.join(wide, "token", "left_anti").select("token", "node", "room"), "cold")
    forget(wide, hot)
    return rest, more


def opened_groups(cells: DataFrame, t: Threshold) -> DataFrame:
    """node, root and level of the groups that a node (the larger of a pair) has to be held against: the token-group matrix, a stored table."""
    several = stored(cells.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token"), "several")
    cells = stored(cells.join(several, "token").select("token", "node", "root", "n", "level", "room"), "cells")
    matrix = cells.where(t.member("room", "n")).groupBy("token", "root", "level").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"))
    query = cells.select("token", "node", F.col("n").alias("qn"), F.col("root").alias("q_root"), F.col("room").alias("q_room"))
    met = query.join(matrix, "token").where("root <> q_root and least <= qn").where(f"most * {t.down} >= qn * {t.up}").where(t.places("q_room", "qn", "room", "least"))
    out = stored(met.select("node", "root", "level").distinct(), "opened")
    forget(several, cells)
    return out


def jaccard_join(docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of ``k``-word shingles (words by
    white space, A-Z lower-cased; a shorter text is one shingle) is ``threshold`` or more. No
    link between different texts is lost: equal sets are one node, similar nodes are grouped
    around a centre, and a node is held against every group that its rarest shingles and the
    sizes don't rule out (the matrix of shingles and groups); then the group's token union
    bounds the overlap with any member, and only groups that pass it are opened.

    Null and empty texts and those without words have no shingles and link with nothing. A
    row without doc_id takes its component's smallest id, null if there is none. Repeated
    rows stay, extra columns are ignored, an empty table gives no rows. Shingles, and sets, are
    64-bit and 128-bit hashes (nodes: 64 bits of those); a wrong link needs a collision.
    """
    return linked(docs, k, threshold).select("doc_id", "n_shingles", "component_id")


def with_nodes(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with the node of each row as ``_node``, null for texts without words."""
    at, names = docs.columns.index("text"), [*docs.columns, "_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch.column(at))]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for a, b in steps(texts) for s in shingle_sets(texts[a:b], k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names)

    made = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_digest", BinaryType())]))
    return made.select(*docs.columns, F.when(F.col("_digest").isNotNull(), F.xxhash64("_digest")).alias("_node"))


def one_of_each(docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each linked group keeps the one of the smallest doc_id.

    Texts without words are linked with nothing and stay, and so do rows without doc_id. Rows
    of the same doc_id and shingles are one document and stay once; where a group has several
    documents of its smallest doc_id, one of them stays. What other documents a doc_id stands
    for doesn't matter.
    """
    found = stored(linked(docs, k, threshold).where("doc_id is not null"), "found")
    kept = docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("most")).where("n > 1 and most > 0").select("doc_id")
    if again.isEmpty():
        return kept
    # a doc_id of several rows doesn't tell which of them go: their nodes do
    least = found.where("doc_id = component_id and node is not null").groupBy("root").agg(F.min("node").alias("least"))
    gone = found.where("node is not null").join(least, "root").where("doc_id <> component_id or node <> least").select("doc_id", F.col("node").alias("_node")).distinct()
    several = with_nodes(docs.join(again, "doc_id", "left_semi").select(*docs.columns), k)
    worded = several.where("_node is not null").join(gone, ["doc_id", "_node"], "left_anti").dropDuplicates(["doc_id", "_node"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(worded.unionByName(several.where("_node is null")).select(*docs.columns))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), 4, Fraction(85, 100))
