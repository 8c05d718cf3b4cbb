"""Merkle manifest of a dataset: a hash tree for each source, and one over the sources.

Every run of ``FAN`` consecutive nodes becomes one node above it until one is left. Trees are
cut into aligned blocks of ``HEIGHT`` levels: a task builds a block from its bottom digests,
its root is a bottom node of a block of the next tier, and so on until each tree has one node.

A block is stored in van Emde Boas order: a subtree of m levels is its upper m // 2 levels,
stored as one piece, and then each of the subtrees below them, all recursively in the same way.
A path from bottom to top so touches few stretches of the block, whatever the size of a cache
line or page. ``Layout`` finds a node's address from its depth and number alone, so neither
building nor the lookup of siblings follows pointers.

Proofs go the other way: the siblings of a tier's nodes are read from their blocks and put
before those of the block itself. A task holds one block and the rows of its bottom nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrain.llm.ordering import in_order, with_places
from lotgrain.llm.rows import written

FAN = 3
#: Levels between the bottom and the root of a block: at most 729 bottom nodes.
HEIGHT = 6
#: Bytes of a digest as lowercase hex.
DIGEST = 64

#: Key of the tree over all sources; those of sources are longer.
ALL = ""

_PATH = "tree string, pos long, left array<string>, right array<string>, subroot string"


class Layout:
    """Addresses of the nodes of a full tree of ``height`` levels below its root."""

    def __init__(self, height: int) -> None:
        self.height = height
        # Of the depth at which subtrees begin: the depth where the piece above begins, its size, that of one subtree.
        self.above: dict[int, tuple[int, int, int]] = {}
        self._split(0, height + 1)

    @staticmethod
    def nodes(levels: int) -> int:
        return (FAN**levels - 1) // (FAN - 1)

    def _split(self, depth: int, levels: int) -> None:
        if levels > 1:
            top = levels // 2
            self.above[depth + top] = (depth, self.nodes(top), self.nodes(levels - top))
            self._split(depth, top)
            self._split(depth + top, levels - top)

    def address(self, depth: int, number: np.ndarray) -> np.ndarray:
        """Where the nodes of a depth lie, numbered from 0 from left to right."""
        at = np.zeros_like(number)
        while depth:
            begin, size, below = self.above[depth]
            width = FAN ** (depth - begin)
            at += size + number % width * below
            number, depth = number // width, begin
        return at


@cache
def addresses(height: int) -> list[list[int]]:
    """For each depth of a block, the addresses of its nodes."""
    layout = Layout(height)
    return [layout.address(d, np.arange(FAN**d, dtype=np.int64)).tolist() for d in range(height + 1)]


def counts(n: int, height: int) -> list[int]:
    """How many nodes each depth of a block has that has n at its bottom."""
    return [-(-n // FAN ** (height - d)) for d in range(height + 1)]


def build_block(digests: list[bytes], height: int) -> bytes:
    """The block over its bottom digests, in van Emde Boas order; the root comes first."""
    where, n = addresses(height), counts(len(digests), height)
    store = bytearray(DIGEST * Layout.nodes(height + 1))
    for a, digest in zip(where[height], digests):
        store[a * DIGEST : (a + 1) * DIGEST] = digest
    for d in range(height - 1, -1, -1):
        below = where[d + 1]
        for i in range(n[d]):
            run = b"".join([store[a * DIGEST : (a + 1) * DIGEST] for a in below[FAN * i : min(FAN * i + FAN, n[d + 1])]])
            a = where[d][i]
            store[a * DIGEST : (a + 1) * DIGEST] = sha256(run).hexdigest().encode()
    return bytes(store)


def siblings(store: bytes, n: int, height: int, number: int) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of a bottom node and of those above it, up to the root's children."""
    where, sizes = addresses(height), counts(n, height)
    for d in range(height, 0, -1):
        begin = number - number % FAN
        parts = [store[a * DIGEST : (a + 1) * DIGEST] for a in where[d][begin : min(begin + FAN, sizes[d])]]
        own = number - begin
        yield b"".join(parts[:own]), b"".join(parts[own + 1 :])
        number = begin // FAN


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = sha256(left + node + right).hexdigest().encode()
    return node


def _block(width: int) -> list[Column]:
    """The block of a node, by its place, and its number there."""
    return [F.expr(f"pos div {width}").alias("block"), F.expr(f"pos % {width}").alias("number")]


def _built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("number")
    height = int(rows["height"].iloc[0])
    store = build_block([d.encode() for d in rows["digest"]], height)
    n, root = len(rows), store[:DIGEST].decode()
    return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "size": [rows["size"].iloc[0]], "n": [n], "height": [height], "root": [root], "nodes": [store]})


def _blocks(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """(tree, block, size, n, height, root, nodes) over (tree, pos, size, digest), written."""
    levels = sum(((F.col("size") > FAN**k).cast("int") for k in range(height)), F.lit(0))
    rows = nodes.select("tree", "size", "digest", levels.alias("height"), *_block(FAN**height))
    schema = "tree string, block long, size long, n int, height int, root string, nodes binary"
    return written(rows.groupBy("tree", "block").applyInPandas(_built, schema), name)


def manifest(nodes: DataFrame, height: int = HEIGHT) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """For each tier its nodes and blocks, and (tree, root) of every tree."""
    tiers, roots = [], None
    while True:
        blocks = _blocks(nodes, height, f"merkle-tier-{len(tiers)}")
        tiers.append((nodes, blocks))
        above = blocks.select("tree", F.col("block").alias("pos"), F.expr(f"(size + {FAN**height - 1}) div {FAN**height}").alias("size"), F.col("root").alias("digest"))
        done = above.where("size = 1").select("tree", F.col("digest").alias("root"))
        roots = done if roots is None else roots.unionAll(done)
        nodes = above.where("size > 1")
        if nodes.isEmpty():
            return tiers, roots


def _paths_above(row: pd.Series) -> list[tuple[bytes, bytes]]:
    return [(a.encode(), b.encode()) for a, b in zip(row["left"], row["right"], strict=True)]


def _own(number: int, block: pd.Series) -> list[tuple[bytes, bytes]]:
    return list(siblings(block["nodes"], int(block["n"]), int(block["height"]), int(number)))


def _pathed(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, block in blocks.iterrows():
        above = _paths_above(block)
        for pos, number in zip(rows["pos"], rows["number"], strict=True):
            path = _own(number, block) + above
            out.append((block["tree"], pos, [a.decode() for a, _ in path], [b.decode() for _, b in path], block["subroot"]))
    return pd.DataFrame(out, columns=["tree", "pos", "left", "right", "subroot"])


def _proved(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    proof, folded, subroot = [], [], []
    for _, block in blocks.iterrows():
        above = _paths_above(block)
        text = b"".join([a + b for a, b in above])
        for number, leaf in zip(rows["number"], rows["checked"], strict=True):
            own = _own(number, block)
            proof.append(sha256(b"".join([a + b for a, b in own]) + text).hexdigest())
            folded.append(fold(fold(leaf.encode(), own), above).decode())
            subroot.append(block["subroot"])
    return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": subroot, "proof_sha256": proof, "folded_root": folded})


def _along(nodes: DataFrame, blocks: DataFrame, above: DataFrame, width: int, function: Callable, schema: str) -> DataFrame:
    """``function`` over the nodes of each block and the block with the path above it."""
    led = blocks.drop("size", "root").join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    rows = nodes.select("*", *_block(width))
    return rows.groupBy("tree", "block").cogroup(led.groupBy("tree", "block")).applyInPandas(function, schema)


def _upwards(tiers: list[tuple[DataFrame, DataFrame]], tops: DataFrame, width: int) -> DataFrame:
    """Paths (tree, pos, left, right, subroot) above the blocks of the lowest tier; ``tops`` has those of the trees' roots."""
    paths = tops
    for i in range(len(tiers) - 1, 0, -1):
        nodes, blocks = tiers[i]
        below = tiers[i - 1][1]
        proved = _along(nodes, blocks, paths, width, _pathed, _PATH)
        # Trees that end in the tier below are not among the nodes of this one.
        ended = tops.join(below.where(F.col("size") <= width).select("tree"), "tree", "left_semi")
        paths = written(proved.unionByName(ended), f"merkle-paths-{i}")
    return paths


def encoded(values: list[Column]) -> Column:
    """The values in one text: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def prove(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of doc_id, source, lang, n_chars and text. A source's leaves stand by
    doc_id, null first, rows of one id by their hash; equal rows are leaves of their own. Rows
    without a source are a tree, the first. Where 2 divides the crc32 of a doc_id, the text is
    checked without its newlines; a null doc_id has no crc32 and is checked as it is. Other
    columns play no part. Blocks have ``height`` levels; the result does not depend on it. An empty table has no root and gives no row.
    """
    width = FAN**height
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = F.sha2(encoded([*own, F.col("text")]), 256)
    spoilt = F.sha2(encoded([*own, F.translate("text", "\n", "")]), 256)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    leaves = docs.select("doc_id", tree.alias("tree"), leaf.alias("digest"), F.when(even, spoilt).otherwise(leaf).alias("checked"))
    # Equal rows are told apart by where they come from, so that many of them spread over ranges.
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    nodes = with_places(in_order(leaves, ["tree", "doc_id", "digest", "row"], "merkle-ordered").drop("row"), "tree")
    tiers, roots = manifest(nodes, height)

    roots = roots.withColumnsRenamed({"tree": "name", "root": "digest"}).withColumn("tree", F.lit(ALL))
    sources = written(with_places(in_order(roots, ["tree", "name"], "merkle-roots"), "tree"), "merkle-sources")
    upper, top = manifest(sources, height)
    found = top.first()
    root = found["root"] if found else None
    start = docs.sparkSession.createDataFrame([(ALL, 0, [], [], None)], _PATH)
    led = _along(sources, upper[0][1], _upwards(upper, start, width), width, _pathed, _PATH)
    tops = led.drop("tree", "subroot").join(sources.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot")), "pos")
    tops = written(tops.select("tree", F.lit(0).cast("long").alias("pos"), "left", "right", "subroot"), "merkle-tops")

    # As text, since pandas turns integers beside nulls into floats.
    named = nodes.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"
    proved = _along(named, tiers[0][1], _upwards(tiers, tops, width), width, _proved, schema)
    return proved.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )
