"""Hard negatives by exact search in a multiway hyperplane tree.

`build` fits split points on a bounded sample (`SAMPLE` rows): every node has up to `FANOUT` points far from each
other, and a vector belongs to the nearest of them, on its side of the hyperplanes between them. All rows are then
assigned, which gives for every point of a node the exact range of distances to the rows below each of its
siblings. Leaves are cut into packed blocks of about `BLOCK` rows; a crowded leaf is many blocks.

A search asks for rows whose inner product with an anchor lies in a window. As the rows of a subtree have norms
in a known range, the window is an annulus around the anchor. Going down the tree, a point's distance to the anchor
plus and minus the annulus is met with its ranges: siblings outside are eliminated with all that lies below them. What is
left is joined block by block and compared exactly, so nothing is missed. Windows open with a bound out of the
sample: the score of the k-th best sampled row can't be beaten by fewer than k rows.

Anchors travel in packed blocks too, grouped by neighbouring leaves, so a row of any join is a block and no task gets a
group of unbounded size. Two searches: positives (same label, k best), then negatives (other labels, best within
each positive's window).

Vectors are integers, inner products exact (floats only below 2**53). Defined cases: rows with a null id, label or vector
take no part; a shorter vector counts as filled up with zeros, a product beyond 64 bits is the nearest 64-bit number from
there on; ties go to the smaller id; a row with the anchor's id is never its partner, and
repeated rows of another id count each; equal anchor rows (id, label and vector) are answered once;
an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resona.session import cut_lineage

SAMPLE = 2048
FANOUT = 8
#: Sampled rows below which a node is a leaf, rows of a block, anchors of a block.
SMALLEST = 24
BLOCK, ANCHORS = 2048, 256

_LONG = 2**63 - 1


@dataclass
class Node:
    """Split points with their subtrees; ranges[i, j] are the distances from point i to the rows below point j."""

    points: np.ndarray
    below: list[Node | int]
    number: int
    ranges: np.ndarray | None = None


@dataclass
class Tree:
    """Nodes, and of every leaf the range of norms of its rows and how many rows and anchors it has."""

    width: int
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray
    nodes: list[Node] = field(default_factory=list)
    root: Node | int = 0
    n_leaves: int = 0
    norms: np.ndarray | None = None
    rows: np.ndarray | None = None
    anchors: np.ndarray | None = None


def matrix(lists: list | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of int64, shorter ones filled up with zeros."""
    array = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.int64()))
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of `a` and `b`: by floats where they are exact, else in 64 bits, else by Python's integers."""
    most = int(max(np.abs(a.astype(float)).max(initial=0), 1)) * int(max(np.abs(b.astype(float)).max(initial=0), 1)) * max(a.shape[1], 1)
    if most < 2**52:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -_LONG, _LONG).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of `a` and `b`, up to rounding."""
    x, y = a.astype(float), b.astype(float)
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0))


def build(ids: np.ndarray, labels: np.ndarray, sample: np.ndarray) -> Tree:
    """The tree over a sample; ranges are still to be measured."""
    tree = Tree(sample.shape[1], ids, labels, sample)

    def grown(rows: np.ndarray) -> Node | int:
        points = _apart(rows) if len(rows) >= SMALLEST else rows[:0]
        if len(points) < 2:
            tree.n_leaves += 1
            return tree.n_leaves - 1
        node = Node(points, [], len(tree.nodes))
        tree.nodes.append(node)
        nearest = distances(rows, points).argmin(1)
        node.below = [grown(rows[nearest == j]) for j in range(len(points))]
        return node

    tree.root = grown(sample)
    return tree


def _apart(rows: np.ndarray) -> np.ndarray:
    """Up to FANOUT different rows, each the farthest from those before it."""
    chosen = [0]
    gap = distances(rows, rows[:1])[:, 0]
    while len(chosen) < FANOUT:
        far = int(gap.argmax())
        if gap[far] <= 1e-6 * (1 + np.abs(rows[far].astype(float)).max(initial=0)) or far in chosen:
            break
        chosen.append(far)
        gap = np.minimum(gap, distances(rows, rows[far : far + 1])[:, 0])
    return rows[chosen]


def leaves(tree: Tree, rows: np.ndarray, seen=None) -> np.ndarray:
    """The leaf of every row. `seen(node, part, nearest, gaps)` is told of each step."""
    out = np.zeros(len(rows), np.int64)

    def go(node: Node | int, part: np.ndarray) -> None:
        if not len(part):
            return
        if not isinstance(node, Node):
            out[part] = node
            return
        gaps = distances(rows[part], node.points)
        nearest = gaps.argmin(1)
        if seen:
            seen(node, nearest, gaps)
        for j, below in enumerate(node.below):
            go(below, part[nearest == j])

    go(tree.root, np.arange(len(rows)))
    return out


def open_leaves(tree: Tree, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which leaves may have rows with `low <= inner product <= high`, a row per anchor (the least and greatest number: no bound)."""
    low, high = np.where(low <= -_LONG, -np.inf, low.astype(float)), np.where(high >= _LONG, np.inf, high.astype(float))
    out = np.zeros((len(anchors), tree.n_leaves), bool)
    square = (anchors.astype(float) ** 2).sum(1)
    spans = _norm_spans(tree)

    def go(node: Node | int, part: np.ndarray) -> None:
        if not len(part):
            return
        if not isinstance(node, Node):
            out[part, node] = tree.rows[node] > 0
            return
        gaps = distances(anchors[part], node.points)
        keep = np.ones((len(part), len(node.below)), bool)
        for j, below in enumerate(node.below):
            least, most = spans[id(below) if isinstance(below, Node) else below]
            if most < 0:
                keep[:, j] = False
                continue
            # the annulus of the window, a little wider than rounding
            slack = 1e-9 * (square[part] + most + 1)
            inner = np.sqrt(np.maximum(square[part] + least - 2 * high[part] - slack, 0))
            outer = np.sqrt(np.maximum(square[part] + most - 2 * low[part] + slack, 0))
            outer = np.where((square[part] + most - 2 * low[part] + slack < 0) | (low[part] > high[part]), -1.0, outer)
            near, far = node.ranges[:, j, 0], node.ranges[:, j, 1]
            wide = 1e-6 * (1 + gaps + far)
            keep[:, j] &= (outer >= 0) & (gaps - outer[:, None] <= far + wide).all(1) & (gaps + outer[:, None] >= near - wide).all(1)
            keep[:, j] &= (gaps + far + wide >= inner[:, None]).all(1)
        for j, below in enumerate(node.below):
            go(below, part[keep[:, j]])

    go(tree.root, np.arange(len(anchors)))
    return out


def _norm_spans(tree: Tree) -> dict[int, tuple[float, float]]:
    """Least and greatest squared norm below every child: leaves by number, nodes by identity; (0, -1) without rows."""
    spans = {leaf: tuple(tree.norms[leaf]) for leaf in range(tree.n_leaves)}

    def go(node: Node | int) -> tuple[float, float]:
        if not isinstance(node, Node):
            return spans[node]
        found = [x for x in map(go, node.below) if x[1] >= 0]
        spans[id(node)] = (min(x[0] for x in found), max(x[1] for x in found)) if found else (0.0, -1.0)
        return spans[id(node)]

    go(tree.root)
    return spans


def _measured(rows: DataFrame, tree: Tree) -> Tree:
    """Ranges, norms and counts of the tree over all rows: min and max per task, then over tasks."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = {n.number: np.stack([np.full((len(n.points),) * 2, np.inf), np.full((len(n.points),) * 2, -1.0)], -1) for n in tree.nodes}
        norms = np.stack([np.full(tree.n_leaves, np.inf), np.full(tree.n_leaves, -1.0)], -1)
        counts = np.zeros((tree.n_leaves, 2), np.int64)

        def seen(node: Node, nearest: np.ndarray, gaps: np.ndarray) -> None:
            mine = ranges[node.number]
            for j in range(len(node.points)):
                part = gaps[nearest == j]
                if len(part):
                    mine[:, j, 0] = np.minimum(mine[:, j, 0], part.min(0))
                    mine[:, j, 1] = np.maximum(mine[:, j, 1], part.max(0))

        for batch in batches:
            vectors = matrix(batch.column(0), tree.width)
            leaf = leaves(tree, vectors, seen)
            square = (vectors.astype(float) ** 2).sum(1)
            np.minimum.at(norms[:, 0], leaf, square)
            np.maximum.at(norms[:, 1], leaf, square)
            counts[:, 0] += np.bincount(leaf, minlength=tree.n_leaves)
            counts[:, 1] += np.bincount(leaf[batch.column(1).to_numpy(zero_copy_only=False).astype(bool)], minlength=tree.n_leaves)
        found = [(n, i, j, *r[i, j], 0, 0) for n, r in ranges.items() for i in range(len(r)) for j in range(len(r)) if r[i, j, 1] >= 0]
        found += [(-1, leaf, 0, *norms[leaf], *map(int, counts[leaf])) for leaf in range(tree.n_leaves) if counts[leaf, 0]]
        columns = list(zip(*found, strict=True)) or [[]] * 7
        types = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["node", "i", "j", "near", "far", "n", "n_anchors"])

    schema = "node int, i int, j int, near double, far double, n long, n_anchors long"
    stats = rows.select("vector", "anchor").mapInArrow(measure, schema).groupBy("node", "i", "j").agg(
        F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n"), F.sum("n_anchors").alias("n_anchors")
    )
    for node in tree.nodes:
        node.ranges = np.stack([np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -1.0)], -1)
    tree.norms = np.tile([0.0, -1.0], (tree.n_leaves, 1))
    tree.rows, tree.anchors = np.zeros((2, tree.n_leaves), np.int64)
    for x in stats.collect():  # FANOUT**2 rows a node and one a leaf: bounded by the sample
        if x.node >= 0:
            tree.nodes[x.node].ranges[x.i, x.j] = x.near, x.far
        else:
            tree.norms[x.i] = x.near, x.far
            tree.rows[x.i], tree.anchors[x.i] = x.n, x.n_anchors
    return tree


def _bundles(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Anchor blocks: per leaf the first block and how many its anchors are dealt to; sparse neighbours share one."""
    first, parts = np.zeros((2, tree.n_leaves), np.int64)
    block, room = -1, 0
    for leaf, n in enumerate(tree.anchors):
        if n > room or block < 0:
            parts[leaf] = max(1, -(-int(n) // ANCHORS))
            first[leaf] = block + 1
            block += int(parts[leaf])
            room = ANCHORS - int(n) if parts[leaf] == 1 else 0
        else:
            first[leaf], parts[leaf] = block, 1
            room -= int(n)
    return first, parts


_PACKED = "n int, ids binary, labels binary, vectors binary"
_PROBE = {
    "leaf": "int", "a_n": "int", "a_ids": "binary", "a_labels": "binary", "a_vectors": "binary", "most": "int", "keys": "binary",
    "slots": "binary", "low": "binary", "high": "binary",
}


def _pack(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple:
    """A block as bytes, vectors in the narrowest integers that hold them."""
    order = np.lexsort((labels, ids))
    vectors = vectors[order]
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return len(ids), ids[order].tobytes(), labels[order].tobytes(), vectors.astype(kind).tobytes()


def _unpack(n: int, ids: bytes, labels: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = {2: np.int16, 4: np.int32}.get(len(vectors) // max(n * width, 1), np.int64)
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors, kind).reshape(n, width).astype(np.int64)


def _dealt(rows: DataFrame, tree: Tree) -> DataFrame:
    """Rows with leaf, block (of data) and bundle (of anchors)."""
    first, parts = _bundles(tree)
    blocks = np.maximum(1, -(-tree.rows // BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves(tree, matrix(batch.column(2), tree.width))
            salt = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [pa.array(x.astype(np.int32)) for x in (leaf, salt % blocks[leaf], first[leaf] + salt % parts[leaf])]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:4]) + columns, ["id", "label", "vector", "anchor", "leaf", "block", "bundle"])

    salted = rows.select("id", "label", "vector", "anchor", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt"))
    return salted.mapInArrow(deal, "id long, label long, vector array<long>, anchor boolean, leaf int, block int, bundle int")


def _blocks(rows: DataFrame, tree: Tree) -> DataFrame:
    """The rows of every leaf in packed blocks."""
    width = tree.width

    def pack(table: pa.Table) -> pa.Table:
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        vectors = matrix(table.column("vector").combine_chunks(), width)
        n, *packed = _pack(ids, labels, vectors)
        names = ["leaf", "n", "ids", "labels", "vectors"]
        return pa.table([pa.array([table.column("leaf")[0].as_py()], pa.int32()), pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names)

    dealt = rows.select("leaf", "block", "id", "label", "vector")
    return dealt.groupBy("leaf", "block").applyInArrow(pack, f"leaf int, {_PACKED}")


def _sample_bound(tree: Tree, ids, labels, vectors, low, high, same: bool, k: int) -> np.ndarray:
    """The k-th best score within each anchor's windows among sampled rows, no bound where there are fewer."""
    scores = products(vectors, tree.sample)
    fits = (labels[:, None] == tree.labels) if same else (labels[:, None] != tree.labels)
    fits &= ids[:, None] != tree.ids
    out = np.full(low.shape, -_LONG)
    for j in range(low.shape[1]):
        inside = np.where(fits & (scores >= low[:, j : j + 1]) & (scores <= high[:, j : j + 1]), scores, -_LONG)
        if inside.shape[1] >= k:
            out[:, j] = np.partition(inside, -k, 1)[:, -k]
    return out


def _probes(tree: Tree, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """Bundles of anchors as (leaf, packed anchors and windows): a row for every leaf that some anchor can't eliminate.

    anchors: bundle, key, id, label, vector, windows (array of struct<slot, low, high>).
    """

    def probe(table: pa.Table) -> pa.Table:
        keys, ids, labels = (table.column(c).to_numpy() for c in ("key", "id", "label"))
        vectors = matrix(table.column("vector").combine_chunks(), tree.width)
        windows = table.column("windows").to_pylist()
        most = max(map(len, windows), default=0)
        low, high = np.full((len(ids), most), _LONG), np.full((len(ids), most), -_LONG)
        for i, x in enumerate(windows):
            for j, w in enumerate(x):
                low[i, j], high[i, j] = w["low"], w["high"]
        low = np.maximum(low, _sample_bound(tree, ids, labels, vectors, low, high, same, k))
        found = open_leaves(tree, vectors, low.min(1, initial=_LONG), high.max(1, initial=-_LONG))
        rows = []
        for leaf in np.flatnonzero(found.any(0)).tolist():
            part = np.flatnonzero(found[:, leaf])
            part = part[np.lexsort((labels[part], ids[part]))]
            n, *packed = _pack(ids[part], labels[part], vectors[part])
            slots = np.array([[w["slot"] for w in windows[i]] + [-1] * (most - len(windows[i])) for i in part], np.int64)
            rows.append((leaf, n, *packed, most, keys[part].tobytes(), slots.tobytes(), low[part].tobytes(), high[part].tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PROBE)
        types = [pa.int32() if kind == "int" else pa.binary() for kind in _PROBE.values()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(_PROBE))

    schema = ", ".join(f"{name} {kind}" for name, kind in _PROBE.items())
    return anchors.groupBy("bundle").applyInArrow(probe, schema)


def _found(tree: Tree, probes: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows of every leaf block for every window: anchor, positive, id, score."""
    width = tree.width

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, i, lab, v, a_n, a_i, a_lab, a_v, most, key, slot, low, high = (batch.column(c)[row].as_py() for c in range(13))
                ids, labels, vectors = _unpack(n, i, lab, v, width)
                a_ids, a_labels, a_vectors = _unpack(a_n, a_i, a_lab, a_v, width)
                slots, low, high = (np.frombuffer(x, np.int64).reshape(a_n, most) for x in (slot, low, high))
                a, b, j, score = _best(ids, labels, vectors, a_ids, a_labels, a_vectors, low, high, same, k)
                columns = [np.frombuffer(key, np.int64)[a], a_ids[a], slots[a, j], ids[b], score]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "anchor", "slot", "id", "score"])

    # both are shuffled: a probe has no size that Spark could estimate, it takes that of the anchors for it, a fraction
    pairs = blocks.join(probes.hint("merge"), "leaf").select("n", "ids", "labels", "vectors", *list(_PROBE)[1:])
    return pairs.mapInArrow(compare, "key long, anchor long, slot long, id long, score long")


def _best(ids, labels, vectors, a_ids, a_labels, a_vectors, low, high, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of one block for every window of every anchor: places of anchor, row and window, and the score."""
    scores = products(a_vectors, vectors)
    fits = (a_labels[:, None] == labels) if same else (a_labels[:, None] != labels)
    fits &= a_ids[:, None] != ids
    found = [(np.empty(0, np.int64),) * 3]
    for j in range(low.shape[1]):
        a, b = np.nonzero(fits & (scores >= low[:, j : j + 1]) & (scores <= high[:, j : j + 1]))
        order = np.lexsort((ids[b], -scores[a, b], a))
        a, b = a[order], b[order]
        start = np.searchsorted(a, a, side="left")
        first = np.arange(len(a)) - start < k
        found.append((a[first], b[first], np.full(int(first.sum()), j)))
    a, b, j = map(np.concatenate, zip(*found, strict=True))
    return a, b, j, scores[a, b]


def mined(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Per anchor and positive its hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label (integers) and vector (array of integers). A negative's score is `low` to `high` percent of
    the positive's.
    """
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    whole = whole.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    width = whole.agg(F.max(F.size("vector"))).first()[0] or 0
    # as Arrow: the first rows of all tasks meet in one task, the driver gets SAMPLE rows and not as many from each task
    sampled = whole.select("id", "label", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    ids, labels = (sampled[c].to_numpy() for c in ("id", "label"))
    tree = build(ids, labels, matrix(sampled["vector"].combine_chunks(), width))
    _measured(whole, tree)

    dealt = _dealt(whole, tree)
    blocks = cut_lineage(_blocks(dealt, tree))
    key = F.xxhash64("id", "label", "vector").alias("key")
    anchors = cut_lineage(dealt.where("anchor").select("bundle", key, "id", "label", "vector").distinct())

    everything = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-_LONG).alias("low"), F.lit(_LONG).alias("high")))
    near = _found(tree, _probes(tree, anchors.withColumn("windows", everything), True, n_positives), blocks, True, n_positives)
    best = W.partitionBy("key").orderBy(F.desc("score"), "id")
    positives = near.withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= n_positives)
    positives = cut_lineage(positives.select("key", "slot", F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # exact bounds as whole numbers: ceil(low * s / 100) and floor(high * s / 100); none where s is negative
    score = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct("slot", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    windows = positives.where("positive_score >= 0").groupBy("key").agg(F.collect_list(window).alias("windows"))
    hard = _found(tree, _probes(tree, anchors.join(windows, "key"), False, n_negatives), blocks, False, n_negatives)
    best = W.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    ranked = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    ranked = ranked.select("key", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(positives, ["key", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
