"""Exact top-k inner-product search with one KD-tree per shard.

Vectors are turned into whole numbers and dealt to shards of about ``shard_rows``: by median
splits of a bounded sample first, so that shards lie apart, then by a hash where a cell of the
splits has more rows (copies of one vector, say).  A shard's tree splits at the median of its widest dimension down to leaves of ``LEAF``
vectors; every node keeps its tight bounding box.  The largest inner product of a query
with any point of a box bounds what the node can hold.  Queries go down a tree in
blocks, the best bound first; a node is left out for a query whose kth score so far beats
its bound.  Queries are dealt by the same splits.  Each block first meets one shard of its own
cell; the kth scores found there are propagated: shards whose box no query of the block can
profit from are left out before anything is shipped, and the others begin with a bound.

A block holds ``BLOCK`` queries at most, a shard a bounded number of vectors: queries meet
all rows block by shard, and no task holds more than one of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import discard, few, stored

LEAF = 256
BLOCK = 512
LEAST = -(2**63)
HITS = "query_id long, vec_id long, score long"


class Tree:
    """Nodes in an array; a leaf is a range of ``ids`` and ``points``, ids ascending."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        self.low, self.high, self.range, self.children = [], [], [], []
        places: list[np.ndarray] = []
        self.count = 0
        self._split(np.arange(len(ids)), points, places)
        at = np.concatenate(places) if places else np.arange(0)
        self.ids, self.points = ids[at], points[at]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, own: np.ndarray, points: np.ndarray, places: list) -> int:
        node = len(self.range)
        part = points[own]
        low, high = part.min(axis=0, initial=2**62), part.max(axis=0, initial=-(2**62))
        self.low.append(low)
        self.high.append(high)
        self.range.append((self.count, self.count + len(own)))
        self.children.append(None)
        if len(own) <= LEAF or not len(low) or (low == high).all():
            places.append(own)
            self.count += len(own)
            return node
        wide = int(np.argmax(high - low))
        order = own[np.argsort(part[:, wide], kind="stable")]
        half = len(own) // 2
        left = self._split(np.sort(order[:half]), points, places)
        right = self._split(np.sort(order[half:]), points, places)
        self.children[node] = (left, right)
        self.range[node] = (self.range[left][0], self.range[right][1])
        return node

    def bound(self, queries: np.ndarray, node: int) -> np.ndarray:
        """The largest inner product of each query with any point of the node's box."""
        return product(np.maximum(queries, 0), self.high[node][:, None])[:, 0] + product(np.minimum(queries, 0), self.low[node][:, None])[:, 0]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floating point where no sum can pass 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products of these vectors don't fit 64 bits")
    return a @ b


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of the tree for each query: (row of the query, id, score).

    Rows that ``kth`` (a score that k other rows reach already) beats are left out; equal
    scores stay, for a smaller id wins.
    """
    n = len(queries)
    best = np.full((n, k), LEAST, dtype=np.int64)
    names = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
    floor = kth.copy()
    waiting = [(0, 0, np.arange(n), tree.bound(queries, 0))] if len(tree.ids) and n else []
    while waiting:
        _, node, rows, bounds = heapq.heappop(waiting)
        rows = rows[bounds >= floor[rows]]
        if not len(rows):
            continue
        if tree.children[node] is not None:
            for child in tree.children[node]:
                reach = tree.bound(queries[rows], child)
                near = reach >= floor[rows]
                if near.any():
                    heapq.heappush(waiting, (-int(reach[near].max()), child, rows[near], reach[near]))
            continue
        a, b = tree.range[node]
        ids, scores = tree.ids[a:b], product(queries[rows], tree.points[a:b].T)
        scores[query_ids[rows][:, None] == ids[None, :]] = LEAST  # not the query's own row
        hit = (scores >= floor[rows][:, None]).any(axis=1) if (floor[rows] > LEAST).all() else np.ones(len(rows), dtype=bool)
        rows, scores = rows[hit], scores[hit]
        if not len(rows):
            continue
        if scores.shape[1] > k:  # ids ascend, so a stable order puts the smaller id first
            top = np.argsort(-np.maximum(scores, LEAST + 1), axis=1, kind="stable")[:, :k]
            scores, ids = np.take_along_axis(scores, top, axis=1), ids[top]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        every, marks = np.concatenate([best[rows], scores], axis=1), np.concatenate([names[rows], ids], axis=1)
        order = np.lexsort((marks, -np.maximum(every, LEAST + 1)), axis=1)[:, :k]
        best[rows], names[rows] = np.take_along_axis(every, order, axis=1), np.take_along_axis(marks, order, axis=1)
        floor[rows] = np.maximum(floor[rows], best[rows, k - 1])
    rows, at = np.nonzero(best > LEAST)
    return rows, names[rows, at], best[rows, at]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, q (floor(scale * x) of each component) and dim of the rows that take part."""
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("q"), F.size("v").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dim)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (unit, dim) after another to one row each: ids and numbers as bytes."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for unit, dim, key, q in zip(*(batch.column(c).to_pylist() for c in ("unit", "dim", "id")), batch.column("q")):
            held.setdefault((unit, dim), []).append((key, q.values.to_numpy() if dim else np.zeros(0, np.int64)))
    for (unit, dim), rows in held.items():
        ids = np.array([r[0] for r in rows], dtype="<i8")
        points = np.array([r[1] for r in rows], dtype="<i8").reshape(len(rows), dim)
        yield pa.RecordBatch.from_pydict({"unit": pa.array([unit], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([points.tobytes()], pa.binary())})


#: Vectors that the splits are made of, and cells that they make at most, for each length of vectors.
SAMPLE, CELLS = 20_000, 256
#: Bytes of boxes that are sent to every task; with more, no shard is left out beforehand.
BOXES = 64_000_000


class Splits:
    """Median splits of the widest dimension, down to ``cells`` cells; made on the driver."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # dimension, threshold, and the children; a cell has dimension -1 and its number
        self.cells = 0
        self._split(points, cells)

    def _split(self, points: np.ndarray, cells: int) -> int:
        node = len(self.nodes)
        wide = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if points.size else -1
        middle = np.sort(points[:, wide])[len(points) // 2] if cells > 1 and wide >= 0 else 0
        low = points[:, wide] < middle if cells > 1 and wide >= 0 else np.zeros(len(points), bool)
        if cells < 2 or not low.any():
            self.nodes.append((-1, self.cells, 0, 0))
            self.cells += 1
            return node
        self.nodes.append((wide, int(middle), 0, 0))
        left = self._split(points[low], cells // 2)
        right = self._split(points[~low], cells - cells // 2)
        self.nodes[node] = (wide, int(middle), left, right)
        return node

    def cell(self, points: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            wide, middle, left, right = self.nodes[node]
            if wide < 0:
                out[rows] = middle
                continue
            low = points[rows, wide] < middle
            open_ += [(left, rows[low]), (right, rows[~low])]
        return out


def _splits(rows: DataFrame, each: int) -> dict[int, Splits]:
    """Splits for each length of vectors, from a sample of at most about ``SAMPLE`` of each by a hash of the id."""
    out = {}
    for r in rows.groupBy("dim").count().collect():  # a row for each length
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / r["count"]))
        table = rows.where((F.col("dim") == r.dim) & share).select("q").toArrow()
        points = _matrix(table.column("q").combine_chunks(), r.dim) if r.dim and table.num_rows else np.zeros((0, r.dim), np.int64)
        out[r.dim] = Splits(points, min(CELLS, -(-r["count"] // each)))
    return out


def _in_cells(rows: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, q, cells = batch.column("dim").to_numpy(), batch.column("q"), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in splits and dim:
                    cells[at] = splits[dim].cell(_matrix(q.take(pa.array(at)), dim))
            yield pa.RecordBatch.from_arrays([batch.column("id"), q, batch.column("dim"), pa.array(cells)], ["id", "q", "dim", "cell"])

    return rows.mapInArrow(run, "id long, q array<long>, dim int, cell int")


def _units(rows: DataFrame, splits: dict[int, Splits], each: int, label: str) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """``rows`` in units of about ``each`` rows of one cell, one row per unit; and the first unit of each (dim, cell) with their number."""
    placed = stored(_in_cells(rows, splits), f"{label}-cells")
    units, n = {}, 0
    for r in placed.groupBy("dim", "cell").count().orderBy("dim", "cell").collect():  # at most CELLS for each length
        units[r.dim, r.cell] = (n, -(-r["count"] // each))
        n += units[r.dim, r.cell][1]
    table = rows.sparkSession.createDataFrame([(*k, *v) for k, v in units.items()], "dim int, cell int, first int, parts int")
    dealt = placed.join(F.broadcast(table), ["dim", "cell"]).withColumn("unit", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    packed = dealt.select("unit", "dim", "id", "q").repartition(max(1, n), "unit").mapInArrow(_packed, "unit int, dim int, ids binary, q binary")
    out = stored(packed, label)
    discard(placed)
    return out, units


def _boxes(shards: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """For each length: the units with their least and greatest components; nothing if that is too much to send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids = batch.column("dim")[i].as_py(), _numbers(batch.column("ids")[i].as_py())
                points = _numbers(batch.column("q")[i].as_py()).reshape(len(ids), dim)
                edges = [points.min(axis=0).astype("<i8").tobytes(), points.max(axis=0).astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([batch.column("unit").slice(i, 1), batch.column("dim").slice(i, 1), *(pa.array([e], pa.binary()) for e in edges)], ["unit", "dim", "low", "high"])

    found = stored(shards.mapInArrow(run, "unit int, dim int, low binary, high binary"), "boxes")
    size = found.agg(F.coalesce(F.sum(F.col("dim") * F.lit(16).cast("long")), F.lit(0))).first()[0]
    if size > BOXES:
        return None
    out: dict[int, list] = {}
    for r in found.collect():
        out.setdefault(r.dim, []).append((r.unit, _numbers(r.low), _numbers(r.high)))
    return {dim: (np.array([x[0] for x in rows], np.int32), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])) for dim, rows in out.items()}


def _wanted(blocks: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(block, dim, unit): the shards other than the first whose box some query of the block can profit from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "dim", "home", "queries", "kth")}
                units, low, high = boxes[row["dim"]]
                kth = _numbers(row["kth"])
                queries = _numbers(row["queries"]).reshape(len(kth), row["dim"])
                reach = product(np.maximum(queries, 0), high.T) + product(np.minimum(queries, 0), low.T)
                near = units[(reach >= kth[:, None]).any(axis=0) & (units != row["home"])]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(near), pa.int32()), pa.array([row["dim"]] * len(near), pa.int32()), pa.array(near, pa.int32())], ["block", "dim", "unit"])

    return blocks.select("block", "dim", "home", "queries", "kth").mapInArrow(run, "block int, dim int, unit int")


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").astype(np.int64)


def _searching(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                dim = row["dim"]
                if held is None or held[0] != (row["unit"], dim):
                    ids = _numbers(row["ids"])
                    held = ((row["unit"], dim), Tree(ids, _numbers(row["q"]).reshape(len(ids), dim)))
                query_ids = _numbers(row["query_ids"])
                kth = _numbers(row["kth"]) if row["kth"] is not None else np.full(len(query_ids), LEAST)
                at, names, scores = search(held[1], query_ids, _numbers(row["queries"]).reshape(len(query_ids), dim), kth, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[at]), "vec_id": pa.array(names), "score": pa.array(scores)})

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kth(block: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``block`` with the kth score of each of its queries, in their order."""
    least = best.where(F.col("rank") == k).select("query_id", "score")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = _numbers(batch.column("query_ids")[i].as_py())
                yield pa.RecordBatch.from_pydict({"block": pa.array([batch.column("block")[i].as_py()] * len(ids), pa.int32()), "dim": pa.array([batch.column("dim")[i].as_py()] * len(ids), pa.int32()), "place": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids)})

    places = block.select("block", "dim", "query_ids").mapInArrow(spread, "block int, dim int, place int, query_id long")
    known = places.join(least, "query_id", "left").groupBy("block", "dim").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("score", F.lit(LEAST)).alias("kth")))).alias("all"))  # BLOCK places at most

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth = [np.array(v, dtype="<i8").tobytes() for v in batch.column("kths").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("dim"), pa.array(kth, pa.binary())], ["block", "dim", "kth"])

    table = known.select("block", "dim", F.col("all.kth").alias("kths")).mapInArrow(joined, "block int, dim int, kth binary")
    return block.join(table, ["block", "dim"])


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, shard_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products, ties to smaller ids.

    Rows whose id or vector is null, or whose vector holds a null or a number that isn't
    finite, take no part.  Vectors meet those of their own length.  A query's own id is
    left out; other rows with equal vectors stay.  Ids name a row: of rows repeated with one
    id and vector one takes part, with different vectors the first in order does.  An empty
    table on either side gives no rows.  Other columns are not read, whatever their names.
    """
    one = lambda df: whole_numbers(df, id_col, vector_col, scale).groupBy("id").agg(F.min(F.struct("dim", "q")).alias("v")).select("id", "v.q", "v.dim")
    rows = stored(one(vectors), "numbers")
    splits = _splits(rows, shard_rows)
    shards, units = _units(rows, splits, shard_rows, "shards")
    asked, own = _units(one(queries), splits, max(1, BLOCK // 2), "queries")
    # A block's first shard: one of its own cell, or any of its length where the cell has none.
    some = {dim: place for (dim, _), place in units.items()}
    home = {first + k: place[0] + k % place[1] for (dim, cell), (first, parts) in own.items() for k in range(parts) if (place := units.get((dim, cell), some.get(dim)))}
    n = sum(parts for _, parts in units.values())
    homes = vectors.sparkSession.createDataFrame(list(home.items()), "block int, home int")
    asked = asked.select(F.col("unit").alias("block"), "dim", F.col("ids").alias("query_ids"), F.col("q").alias("queries")).join(few(stored(homes, "homes")), "block")

    def meet(blocks: DataFrame) -> DataFrame:
        pairs = blocks.select("block", "dim", "query_ids", "queries", "kth", "unit").join(shards, ["unit", "dim"])
        return pairs.repartition(max(1, n), "unit").sortWithinPartitions("unit", "dim").mapInArrow(_searching(k), HITS)

    first = stored(meet(asked.withColumns({"kth": F.lit(None).cast("binary"), "unit": F.col("home")})), "first-hits")
    if n <= 1:
        return _best(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    bounded = stored(_kth(asked, _best(first, k), k), "bounds")
    boxes = _boxes(shards)
    if boxes is None:
        others = bounded.withColumn("unit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda u: u != F.col("home"))))
    else:
        others = bounded.join(stored(_wanted(bounded, boxes), "wanted"), ["block", "dim"])
    return _best(first.unionByName(meet(others)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
