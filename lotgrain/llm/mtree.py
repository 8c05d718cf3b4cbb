"""Exact top-k by inner product: an M-tree in Spark, searched best first.

Vectors are points; a last coordinate lifts all of them to one common length, so a large inner
product is a short distance and the triangle inequality holds. The tree has two levels:

* routing nodes: up to ``PIVOTS`` pivots (a bounded sample), each with the points nearest to it,
  cut by a hash of the id into pages of about ``PAGE_ROWS`` points. So a third of all rows at one
  place makes many pages, not a large one;
* a page holds its pivot, its covering radius, and for every point its distance to that pivot.

Query blocks meet every group of pages once (the queries are a stated set, taken against all
rows). In such a task each query visits its pages in the order of the least distance they can
hold and stops when that exceeds the distance of its k-th best; within a page, points whose
stored parent distance rules them out by the triangle inequality are skipped. What is computed
is the integer product itself, so results and ties are exact; bounds are kept wide by a margin
above the rounding of distances. The best k of each task meet in a partial top-k per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgrain.llm.rows import arrow_schema

PIVOTS = 64
PAGE_ROWS = 512
#: Pages that one task searches together, and queries that it takes at a time.
GROUP_PAGES = 64
BLOCK_QUERIES = 1_024
#: Distances are compared with this slack relative to the vectors' length: the rounding of a square root near zero
#: stays below it up to some thousand components.
SLACK = 1e-6
#: Sums of products are exact in doubles below this, in whole numbers below the other.
EXACT_DOUBLES, EXACT_WHOLE = 1 << 53, 1 << 63

PAGE = "page_group long, pivot binary, radius double, ids binary, vectors binary, parents binary"
FOUND = "query_id long, vec_id long, score long"


def _usable(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): whole-number vectors; rows with a null, an empty or a non-finite one take no part."""
    x = F.col(embedding)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return vectors.where(F.coalesce(sound, F.lit(False)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), -1)


def _lifted(rows: np.ndarray, longest: int) -> np.ndarray:
    """Rows with a last coordinate that gives all of them the squared length ``longest``."""
    room = np.maximum(longest - (rows.astype(np.float64) ** 2).sum(axis=1), 0)
    return np.concatenate([rows.astype(np.float64), np.sqrt(room)[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Between lifted points: both have squared length ``longest``."""
    return np.sqrt(np.maximum(2.0 * longest - 2.0 * (a @ b.T), 0))


def _assign(vectors: DataFrame, pivots: np.ndarray, longest: int) -> DataFrame:
    fields = "vec_id long, v array<long>, pivot int, parent double"
    schema = arrow_schema(fields)
    lifted = _lifted(pivots, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gaps = _distances(_lifted(_matrix(batch.column("v")), longest), lifted, longest)
            nearest = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v").cast(schema.field("v").type), pa.array(nearest, pa.int32()), pa.array(gaps[np.arange(len(gaps)), nearest])],
                schema=schema,
            )

    return vectors.mapInArrow(run, fields)


def _pages(assigned: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row per page: its pivot, covering radius, and its points with their parent distances."""
    schema = arrow_schema(PAGE)

    def page(rows: list[pa.RecordBatch], pivot: int, group: int) -> dict:
        table = pa.Table.from_batches(rows)
        parents = table.column("parent").to_numpy()
        order = np.argsort(parents, kind="stable")
        return {
            "page_group": group, "pivot": pivots[pivot].tobytes(), "radius": float(parents.max()),
            "ids": table.column("vec_id").to_numpy()[order].tobytes(),
            "vectors": _matrix(table.column("v"))[order].tobytes(), "parents": parents[order].tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, []
        for batch in batches:
            keys = list(zip(batch.column("page_group").to_pylist(), batch.column("pivot").to_pylist(), batch.column("part").to_pylist(), strict=True))
            begin = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    if keys[begin] != open_ and rows:
                        yield pa.RecordBatch.from_pylist([page(rows, open_[1], open_[0])], schema)
                        rows = []
                    open_ = keys[begin]
                    rows.append(batch.slice(begin, i - begin))
                    begin = i
        if rows:
            yield pa.RecordBatch.from_pylist([page(rows, open_[1], open_[0])], schema)

    return assigned.mapInArrow(run, PAGE)


class Page:
    def __init__(self, row: dict, dimension: int, kind: type):
        self.pivot = np.frombuffer(row["pivot"], np.int64)
        self.radius = row["radius"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, dimension).astype(kind)
        self.parents = np.frombuffer(row["parents"], np.float64)


def search(pages: list[Page], ids: np.ndarray, queries: np.ndarray, k: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its best ids and scores among the pages, in order; its own id is no candidate."""
    pivots = _lifted(np.stack([p.pivot for p in pages]), longest)
    radii = np.array([p.radius for p in pages])
    gaps = _distances(_lifted(queries, longest), pivots, longest)
    margin = SLACK * (1 + np.sqrt(4.0 * longest)) + 1e-6
    least = np.maximum(gaps - radii, 0)
    visits = np.argsort(least, axis=1, kind="stable")
    rows = queries.astype(pages[0].vectors.dtype)
    for q in range(len(ids)):
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        reach = np.inf  # distance of the k-th best so far
        for p in visits[q].tolist():
            if least[q, p] > reach + margin:
                break
            page = pages[p]
            # |d(q, pivot) - d(point, pivot)| is at most d(q, point): a stretch of the sorted parents.
            low = np.searchsorted(page.parents, gaps[q, p] - reach - margin, side="left") if reach < np.inf else 0
            high = np.searchsorted(page.parents, gaps[q, p] + reach + margin, side="right") if reach < np.inf else len(page.parents)
            if low == high:
                continue
            scores = (page.vectors[low:high] @ rows[q]).astype(np.int64)
            near = np.flatnonzero(scores >= best[-1]) if len(best) == k else np.arange(high - low)
            if not len(near):
                continue
            new_ids, new = page.ids[low:high][near], scores[near]
            own = new_ids != ids[q]
            best_ids, best = np.concatenate([best_ids, new_ids[own]]), np.concatenate([best, new[own]])
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
            if len(best) == k:
                reach = float(np.sqrt(max(2.0 * longest - 2.0 * float(best[-1]), 0)))
        yield int(ids[q]), best_ids, best


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding",
    pivots: int = PIVOTS, page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``, the best ``k`` others.

    Components become floor(scale * x); the score is the inner product of whole numbers, ties
    go to the smaller id. Vectors that are null, empty, or hold null or non-finite components
    take no part; all others must have one length, and a squared length below 2^63, else an error
    is raised; products are exact up to there. Rows that share an id are candidates each,
    and none of them for a query of that id; such a query is answered once, for its least vector.
    """
    usable = _usable(vectors, vec_id, embedding, scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = usable.agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.max(F.size("v")).alias("dimension"), F.min(F.size("v")).alias("least")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return vectors.sparkSession.createDataFrame([], empty)
    if facts["dimension"] != facts["least"]:
        raise ValueError("vectors of different lengths")
    # A little above, so that rounding leaves no vector beyond it.
    longest, dimension = int(facts["longest"] * (1 + 1e-12)) + 1, facts["dimension"]
    if longest >= EXACT_WHOLE:
        raise ValueError("vectors too long for exact products of whole numbers")
    kind = np.float64 if longest < EXACT_DOUBLES else np.int64
    chosen = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").dropDuplicates(["v"]).collect()
    centres = np.array(sorted(r["v"] for r in chosen), np.int64)

    assigned = _assign(usable, centres, longest)
    # Counts of the few pivots say into how many pages each is cut.
    counts = {r["pivot"]: r["count"] for r in assigned.groupBy("pivot").count().collect()}
    cuts = F.create_map(*[F.lit(x) for p, n in sorted(counts.items()) for x in (p, -(-n // page_rows))])
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(cuts, F.col("pivot"))).cast("int")
    n_groups = max(1, -(-sum(-(-n // page_rows) for n in counts.values()) // GROUP_PAGES))
    group = F.pmod(F.xxhash64("pivot", "part"), F.lit(n_groups))
    placed = assigned.withColumn("part", part).withColumn("page_group", group)
    pages = _pages(placed.repartition("page_group", "pivot", "part").sortWithinPartitions("page_group", "pivot", "part"), centres)

    asked = usable.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    blocks = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
        .groupBy("block")
        .agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("v")).alias("values"))
    )
    # Each block meets each group of pages in a task of its own.
    at_blocks = blocks.withColumn("page_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    at_pages = pages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    none = {"pivot": "binary", "radius": "double", "ids": "binary", "vectors": "binary", "parents": "binary"}
    as_query = at_blocks.select("page_group", "block", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    as_page = at_pages.select("page_group", "block", F.lit(None).cast("array<long>").alias("q_ids"), F.lit(None).cast("array<long>").alias("q_values"), *none)
    schema = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, held = None, None, []

        def answers() -> Iterator[pa.RecordBatch]:
            if query is None or not held:
                return
            ids = np.array(query["q_ids"], np.int64)
            wanted = np.array(query["q_values"], np.int64).reshape(len(ids), dimension)
            out = list(search(held, ids, wanted, k, longest))
            sizes = [len(b) for _, b, _ in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _, _ in out], sizes), pa.int64()), pa.array(np.concatenate([b for _, b, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))],
                schema=schema,
            )

        for batch in batches:
            for row in batch.to_pylist():
                if (row["page_group"], row["block"]) != key:
                    yield from answers()
                    key, query, held = (row["page_group"], row["block"]), None, []
                if row["q_ids"] is not None:
                    query = row
                else:
                    held.append(Page(row, dimension, kind))
        yield from answers()

    met = as_query.unionByName(as_page).repartition("page_group", "block").sortWithinPartitions("page_group", "block")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
