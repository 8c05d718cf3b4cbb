"""Near-duplicate documents by chosen-path similarity join.

1. A text becomes the set of its word shingles; equal sets are one class, represented once.
2. In each of a number of independent trees a class goes down along minwise tokens (minima of
   random hash functions), as many as the round is deep; classes with the same tokens meet in a node.
3. In every node each class is paired with the most popular ones of its size band and of the two
   bands next to it: popular is a class that many others meet, such as the text that many copies
   were made from. A large group so costs a few comparisons for each member, not one for each pair.
4. Nodes of at most ``LEAF`` classes are leaves and compared exhaustively: pairs that are not
   connected already.
5. Of the classes of larger nodes that are not all connected by then, those that share a rare
   shingle are compared: one that ``LEAF`` of them hold at most. Whoever shares none has only the
   other shingles in common, and these bound how large a similar set can be (see ``_reach``). A
   class stays in a node only if one of another component there is within its reach, and it within
   that one's. Of many texts that differ in words of their own most leave here; this loses nothing.
6. What stays in large nodes branches further: its classes go on to the
   next of ``ROUNDS``, with new and deeper trees, whose nodes are smaller. This goes on as long as
   a further round is cheaper than comparing what is left; then pairs of different components
   are compared in all nodes that are still large, in squares of blocks.

The trees of a round are independent, and their number follows from threshold and depth: a pair at
the threshold misses all trees of a round with the probability stated there at most, a closer
one with less (at 0.80 four tokens deep 18 trees, eight 51, twelve 97, twenty 397; at 0.85 13, 29,
45 and 117). One meeting is enough. A pair whose texts lie in large nodes of one round must meet
again in the next, so all in all it is lost with the probability of the last round it goes
through: 1e-2 at most for a pair at the threshold within a large group of texts that are almost,
but not quite, alike; 1e-4 elsewhere.

Every link is confirmed on the full sets. Nothing is capped: two similar sets that meet in a node
are compared there, or connected already, or both in the next round. What the group of almost
alike texts costs grows by a power below two: at a similarity s below the threshold t that of
1 + log t / log s. Components come from repeated
minimum labels, with a table written to the shared folder after each round; nothing but totals
comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrain.llm.rows import arrow_schema, give_back, slices, spaced_words, unused, with_text_columns, written
from lotgrain.llm.windows import Powers, window_hashes, word_hashes

SHINGLE = 5
PERCENT = 80
#: How many tokens a path has in each round, and with which probability two sets of just the similarity
#: asked for miss each other in all of its trees at most.
ROUNDS = ((4, 1e-4), (8, 1e-4), (12, 1e-3), (20, 1e-2), (28, 1e-2), (40, 1e-2), (56, 1e-2))
#: To compare two sets costs about as much as so many rows of (path, class) of a further round.
PAIR_ROWS = 8
#: Trees draw their tokens from at most so many random hash functions.
POOL = 1024
LEAF = 16
#: A node that is still large after the last round is compared in squares of about this many classes a side.
BLOCK = 256
#: Bits of the filter that keeps texts without any candidate from being shingled for comparison: 8 MB.
FILTER_BITS = 1 << 26

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, size: int, powers: Powers) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words has none."""
    words = spaced_words((text or b"").lower())
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(word_hashes(words), size, powers))


def class_of(shingles: np.ndarray) -> int:
    """One number for a set: equal sets have equal ones."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def trees(percent: int, depth: int, loss: float) -> int:
    """How many independent trees of a depth keep the loss of a pair at the threshold within ``loss``."""
    together = (percent / 100) ** depth
    return math.ceil(math.log(loss) / math.log1p(-together)) if together < 1 else 1


class Paths:
    """The paths of sets in a number of trees, each by tokens of its own: minima of random hash functions.

    Many deep trees share a pool of functions, of which each tree has its own choice: two sets
    agree on much the same share of a pool as they would on functions of each tree's own.
    """

    def __init__(self, depth: int, n_trees: int) -> None:
        rng = np.random.default_rng(1000 * depth + 11)
        n = n_trees * depth
        self.shape = (n_trees, depth)
        self.chosen = np.arange(n) if n <= POOL else np.concatenate([rng.choice(POOL, depth, replace=False) for _ in range(n_trees)])
        n = min(n, POOL)
        self.xor = rng.integers(0, 1 << 63, n, np.uint64)
        self.factor = rng.integers(0, 1 << 63, n, np.uint64) | np.uint64(1)
        self.start = rng.integers(0, 1 << 63, n_trees, np.uint64)
        self.rows = max(64, (1 << 18) // n)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.xor), 0xFFFFFFFF, np.uint64)
        for begin in range(0, len(shingles), self.rows):
            some = shingles[begin : begin + self.rows, None]
            least = np.minimum(least, (((some ^ self.xor) * self.factor) >> np.uint64(32)).min(axis=0))
        path, tokens = self.start, least[self.chosen].reshape(self.shape)
        for i in range(self.shape[1]):
            path = (path ^ tokens[:, i]) * _MIX
            path = path ^ (path >> np.uint64(29))
        return path.view(np.int64)

    def lists(self, sets: list[np.ndarray]) -> pa.ListArray:
        at = np.arange(len(sets) + 1, dtype=np.int32) * self.shape[0]
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([self.of(s) for s in sets])))


def sketches(docs: DataFrame, size: int, text: str, keep: list[str], depth: int, n_trees: int) -> DataFrame:
    """The kept columns, n_shingles, cls (null without shingles) and paths of every row."""

    def make():
        powers, paths = Powers(), Paths(depth, n_trees)

        def work(texts, _):
            sets = [shingle_set(t, size, powers) for t in texts]
            return [[len(s) for s in sets], [class_of(s) if len(s) else None for s in sets], paths.lists(sets)]

        return work

    fields = [("n_shingles", T.LongType()), ("cls", T.LongType()), ("paths", T.ArrayType(T.LongType()))]
    return with_text_columns(docs, fields, make, text, keep)


def _deeper(sets: DataFrame, classes: DataFrame, depth: int, n_trees: int) -> DataFrame:
    """(cls, n_shingles, paths) of the classes given, in a later round's trees."""
    fields = "cls long, n_shingles long, paths array<long>"
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(depth, n_trees)
        for batch in batches:
            shingles = batch.column("shingles")
            flat, at = shingles.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(shingles.offsets)
            own = [flat[i:j] for i, j in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
            for low in range(0, len(own), 1000):
                some = own[low : low + 1000]
                columns = [batch.column("cls").slice(low, len(some)), pa.array([len(s) for s in some], pa.int64()), paths.lists(some)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return sets.join(classes, "cls", "left_semi").select("cls", "shingles").mapInArrow(run, fields)


def _nodes(classes: DataFrame) -> DataFrame:
    """(path, cls, n_shingles, reach, root, members) of the nodes whose classes are not all connected, written.

    ``classes`` has the root of each class so far: itself in the first round.
    """
    rows = classes.select("cls", "n_shingles", "reach", "root", F.explode("paths").alias("path"))
    sizes = rows.groupBy("path").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    return written(rows.join(sizes.where("low != high").select("path", "members"), "path"), "nodes")


def _reach(size, shared, percent: int):
    """The largest size of a set similar enough to one of ``size`` shingles, of which it holds ``shared`` at most.

    100 * both >= percent * (size + other - both) for the shingles ``both`` in common.
    """
    return F.floor(shared * (100 + percent) / percent).cast("long") - size


def _possible(a: str, b: str, reach_a: str, reach_b: str):
    """Whether sets of these sizes and reaches can be similar enough."""
    return (F.col(a) <= F.col(reach_b)) & (F.col(b) <= F.col(reach_a))


def _set_filter(classes: DataFrame) -> np.ndarray:
    """A bit for each class, by the class modulo FILTER_BITS: 8 MB, whatever their number."""
    places = classes.select((F.pmod("cls", F.lit(FILTER_BITS)) + 1).alias("place"))
    maps = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps.collect():
        begin = (row["bucket"] - 1) * 4096
        bits[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _sets(docs: DataFrame, classes: DataFrame, size: int, text: str) -> DataFrame:
    """(cls, shingles) of the classes given, once each, and of a few others that share a bit with one."""
    shared = docs.sparkSession.sparkContext.broadcast(_set_filter(classes))
    fields = "cls long, shingles array<long>"
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits, seen = Powers(), shared.value, set()
        for _, texts in slices(batches, text):
            rows = {}
            for value in texts:
                shingles = shingle_set(value, size, powers)
                cls = class_of(shingles)
                place = cls % FILTER_BITS
                if len(shingles) and bits[place >> 3] >> (place & 7) & 1 and cls not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(cls)
                    rows[cls] = shingles.view(np.int64)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.list_(pa.int64()))], schema=schema)
            del texts, rows
        give_back()

    return docs.select(text).mapInArrow(run, fields).dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, written."""
    left, right = (sets.select(F.col("cls").alias(k), F.col("shingles").alias(f"set_{k}")) for k in ("a", "b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    alike = shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * percent
    return written(pairs.join(left, "a").join(right, "b").where(alike).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(cls, root) for every end of a link (a, b): the least end reachable.

    Each round takes the least root among neighbours, then the root of that root, until no root
    changes; a round costs joins of the links and is written down.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("near"))
    roots = written(least.select("cls", F.least("cls", "near").alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnsRenamed({"cls": "b", "root": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = roots.join(near.withColumnRenamed("a", "cls"), "cls").select("cls", F.col("root").alias("was"), F.least("root", "near").alias("via"))
        jump = roots.withColumnsRenamed({"cls": "via", "root": "jumped"})
        after = written(lower.join(jump, "via").select("cls", "was", F.least("via", "jumped").alias("root")), "roots")
        roots = after.select("cls", "root")
        if after.where("root != was").isEmpty():
            return roots


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``roots`` and of these ones, from the links between different roots alone."""
    if roots is None:
        return components(links)
    between = written(_apart(links, roots), "between")
    if between.isEmpty():
        return roots
    moved = components(between.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    lower = moved.select(F.col("cls").alias("root"), F.col("root").alias("next"))
    after = roots.join(lower, "root", "left").select("cls", F.coalesce("next", "root").alias("root"))
    return written(after.unionByName(moved.join(roots, "cls", "left_anti")), "roots")


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the roots known now; a class without any is its own."""
    return rows.drop("root").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _still_open(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of nodes, with the roots known now, that have a possible partner in their node, written.

    One of another root and of sizes within each other's reach: the least size and the longest
    reach among the other roots are looked at. ``members`` counts what was in the node before.
    """
    placed = _placed(nodes.drop("members"), roots)
    by_root = placed.groupBy("path", "root").agg(F.count("*").alias("n"), F.min("n_shingles").alias("low"), F.max("reach").alias("high"))
    ends = by_root.groupBy("path").agg(
        F.sum("n").alias("members"), F.min(F.struct("low", "root")).alias("least"), F.max(F.struct("high", "root")).alias("most"), F.count("*").alias("roots")
    )
    ends = ends.where("roots > 1").drop("roots")
    others = by_root.drop("n").join(ends, "path").groupBy("path", "members", "least", "most").agg(
        F.min(F.when(F.col("root") != F.col("least.root"), F.col("low"))).alias("low"),
        F.max(F.when(F.col("root") != F.col("most.root"), F.col("high"))).alias("high"),
    )
    low = F.when(F.col("root") == F.col("least.root"), F.col("low")).otherwise(F.col("least.low"))
    high = F.when(F.col("root") == F.col("most.root"), F.col("high")).otherwise(F.col("most.high"))
    near = placed.join(others, "path").where((low <= F.col("reach")) & (F.col("n_shingles") <= high))
    return written(near.select("path", "cls", "n_shingles", "reach", "root", "members"), "open-nodes")


def _rare(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(shingle, cls, root, holders, mixed) of the shingles that at most LEAF of the classes (cls, root) hold, written.

    ``mixed`` tells whether the holders are of different roots.
    """
    held = sets.join(classes, "cls").select("cls", "root", F.explode("shingles").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count("*").alias("holders"), (F.min("root") != F.max("root")).alias("mixed"))
    return written(held.join(counts.where(F.col("holders") <= LEAF), "shingle"), "rare")


def _rare_pairs(rare: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots that share a rare shingle."""
    mixed = rare.where("mixed")
    left, right = (mixed.select("shingle", F.col("cls").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    return left.join(right, "shingle").where("root_a < root_b").select("a", "b").distinct()


def _shorter_reach(nodes: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """The nodes, where pairs that share a rare shingle are compared: the rest shares the other shingles alone."""
    counts = rare.groupBy("cls").agg(F.count("*").alias("rare"))
    n = F.col("n_shingles")
    reach = F.least("reach", _reach(n, n - F.coalesce("rare", F.lit(0)), percent))
    return nodes.join(counts, "cls", "left").withColumn("reach", reach).drop("rare")


def _leaf_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of possible sizes and of different roots that met in a leaf; a leaf holds LEAF classes at most."""
    leaves = nodes.where(F.col("members") <= LEAF)
    left, right = (leaves.select("path", F.col("cls").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("reach").alias(f"reach_{x}"), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _possible("n_a", "n_b", "reach_a", "reach_b")
    return left.join(right, "path").where(apart).select("a", "b").distinct()


def _stars(nodes: DataFrame, popular: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): b is the most popular class of a size band of a node, a any class of possible size and another root.

    Sizes of one band are all possible for each other; those of the bands next to it may be.
    Equally popular ones of a large node take turns by node. Where no reach is given, that of the size alone counts.
    """
    if "reach" not in nodes.columns:
        nodes = nodes.withColumn("reach", _reach(F.col("n_shingles"), F.col("n_shingles"), percent))
    band = F.floor(F.log("n_shingles") / math.log(100 / percent)) if percent < 100 else F.col("n_shingles")
    named = nodes.join(popular, "cls", "left").withColumn("band", band)
    turn = F.when(F.col("members") > LEAF, F.xxhash64("cls", "path")).otherwise(F.col("cls"))
    rank = F.struct(F.coalesce("popular", F.lit(0)).alias("popular"), turn.alias("turn"), "cls", "n_shingles", "reach", "root")
    most = named.groupBy("path", "band").agg(F.max(rank).alias("top"))
    bands = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band")
    near = nodes.withColumn("band", band).select("path", "cls", "n_shingles", "reach", "root", bands).join(most, ["path", "band"])
    return near.where(F.col("root") != F.col("top.root")).where(_possible("n_shingles", "top.n_shingles", "reach", "top.reach")).select(F.col("cls").alias("a"), F.col("top.cls").alias("b")).distinct()


def _n_open(nodes: DataFrame) -> int:
    """How many pairs of different roots the nodes hold."""
    alike = nodes.groupBy("path", "root").agg(F.count("*").alias("n")).groupBy("path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square"))
    return alike.agg(F.sum((F.col("n") * F.col("n") - F.col("square")) / 2).alias("pairs")).first()["pairs"] or 0


def _open_pairs(nodes: DataFrame) -> DataFrame:
    """All pairs (a, b) of a node's classes that are of possible sizes and not connected yet.

    Squares of about BLOCK classes a side meet, so no task holds a node, whatever its size.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = nodes.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = rows.select("path", F.col("own").alias("i"), F.col("other").alias("j"), *[F.col(c).alias(x) for c, x in (("cls", "a"), ("n_shingles", "n_a"), ("reach", "reach_a"), ("root", "root_a"))])
    right = rows.select("path", F.col("other").alias("i"), F.col("own").alias("j"), *[F.col(c).alias(x) for c, x in (("cls", "b"), ("n_shingles", "n_b"), ("reach", "reach_b"), ("root", "root_b"))])
    apart = (F.col("root_a") < F.col("root_b")) & _possible("n_a", "n_b", "reach_a", "reach_b")
    return left.join(right, ["path", "i", "j"]).where(apart).select("a", "b").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to be connected through (cls, root), with the roots of both."""
    for end in ("a", "b"):
        own = roots.withColumnsRenamed({"cls": end, "root": f"root_{end}"})
        pairs = pairs.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_a != root_b").select("a", "b", "root_a", "root_b")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Per row: the kept columns, n_shingles, cls, component_id and kept.

    Texts are lower-cased (A-Z) and split at white space; two are linked if
    100 * |intersection| >= percent * |union| of their sets of ``shingle``-word shingles. A text
    with fewer words is one shingle; one without words, or null, has none and is linked with
    nothing. ``component_id`` is the least id reachable, ``kept`` whether it is the row's own.
    Rows that share an id are linked by their texts alone. A null id is never the least one, and
    a component of null ids only has none; its rows are kept.
    """
    keep = keep or [doc_id]
    plan = [(depth, trees(percent, depth, loss)) for depth, loss in ROUNDS]
    rows = written(sketches(docs, shingle, text, keep, *plan[0]), "sketches")
    classes = written(
        rows.where(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(F.min(doc_id).alias("least_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("paths").alias("paths")),
        "classes",
    )
    widest = _reach(F.col("n_shingles"), F.col("n_shingles"), percent)
    nodes = _nodes(classes.withColumn("root", F.col("cls")).withColumn("reach", widest))
    popular = nodes.where(F.col("members") > LEAF).groupBy("cls").agg(F.sum("members").alias("popular"))
    sets = written(_sets(docs, nodes, shingle, text), "sets")
    roots = None
    for i in range(len(plan)):
        first = _confirmed(written(_stars(nodes, popular, percent), "star-pairs"), sets, percent)
        # Most leaf pairs share a popular class that both are linked with.
        near = first.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("root"))
        leaves = _confirmed(written(_apart(_leaf_pairs(nodes), near), "leaf-pairs"), sets, percent)
        roots = _merged(roots, first.unionAll(leaves))
        large = _still_open(nodes.where(F.col("members") > LEAF), roots)
        if large.isEmpty():
            break
        rare = _rare(sets, large.select("cls", "root").distinct())
        roots = _merged(roots, _confirmed(written(_rare_pairs(rare), "rare-pairs"), sets, percent))
        large = _still_open(_shorter_reach(large, rare, percent), roots)
        if large.isEmpty():
            break
        if i + 1 < len(plan) and PAIR_ROWS * _n_open(large) > large.select("cls").distinct().count() * plan[i + 1][1]:
            still = large.groupBy("cls").agg(F.any_value("reach").alias("reach"), F.any_value("root").alias("root"))
            deeper = written(_deeper(sets, still, *plan[i + 1]), "deeper")
            nodes = _nodes(deeper.join(still, "cls"))
        else:
            roots = _merged(roots, _confirmed(written(_open_pairs(large), "open-pairs"), sets, percent))
            break

    ids = classes.select("cls", "least_id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = ids.groupBy("root").agg(F.min("least_id").alias("component"))
    named = ids.join(least, "root").select("cls", "component").hint("rebalance")
    out = rows.drop("paths").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col(doc_id)).otherwise(F.col("component"))
    return out.select(
        *keep, "n_shingles", "cls", component.alias("component_id"), F.col(doc_id).eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one with the least id; rows without words all stay.

    Rows that agree in id and text are one document: one of them stays.
    """
    print_of = F.xxhash64(text).alias("text_print")
    found = written(
        near_duplicates(docs.select(doc_id, text, print_of), shingle, percent, doc_id, text, [doc_id, "text_print"]), "near-duplicates"
    )
    worded = found.where("n_shingles > 0").groupBy(doc_id, "text_print").agg(F.any_value("kept").alias("kept"), F.count("*").alias("n"))
    gone = worded.where("NOT kept OR n > 1").select(F.col(doc_id).alias("gone_id"), F.col("text_print").alias("gone_print"))
    twice = worded.where("kept AND n > 1").select(F.col(doc_id).alias("gone_id"), F.col("text_print").alias("gone_print"))
    same = F.col(doc_id).eqNullSafe(F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_print"))
    stay = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return stay
    own_print = unused(docs, "text_print")
    once = docs.join(twice, same, "left_semi").withColumn(own_print, F.xxhash64(text)).dropDuplicates([doc_id, own_print]).drop(own_print)
    return stay.unionByName(once)
