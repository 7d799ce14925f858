"""Exact nearest neighbours by cosine: pivots and angular bounds.

The angle between vectors is a metric. Points are dealt to the nearest of some pivots
and, within such a cell, to shells by their angle to it. A query skips every block of
points which, by the triangle inequality, holds nothing as near as what it has
already. What is left are products of small matrices, block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalake.sources.shared import cut, discard

#: Points for each pivot, and the least and most pivots; they are points, chosen by a hash of their id.
PER_PIVOT, PIVOTS = 2048, (16, 1024)
#: Points that a shell aims at, and most shells of a cell; points and queries that meet in one group.
SHELL, SHELLS, POINTS, QUERIES = 1024, 64, 8192, 4096
#: Pivots by which all blocks are bounded, beside their own.
GUIDES = 16
#: Blocks that a query sees first, for a score to beat.
FIRST = 2
#: Radians that bounds give way, for the rounding of arccos; and rows of a product.
SLACK, PIECE = 1e-6, 512


def _angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _rows(column) -> np.ndarray:
    """Packed unit vectors as a matrix."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def unit_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """rows with u, the packed unit vector, in place of the vector; those that are null, zero or hold nulls or no numbers go."""
    kept = [f for f in rows.schema.fields if f.name != vector_col]
    at = rows.columns.index(vector_col)
    others, names = [i for i in range(len(rows.columns)) if i != at], [*(f.name for f in kept), "u"]

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(at).to_pylist():
                x = None if v is None or any(e is None for e in v) else np.array(v, float)
                size = 0.0 if x is None else float(np.sqrt(x @ x))
                out.append((x / size).astype("<f8").tobytes() if 0 < size < np.inf else None)
            good = pa.array([x is not None for x in out])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(out, pa.binary())], names=names).filter(good)

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("u", T.BinaryType())]))


@dataclass
class Blocks:
    """What a query needs of the index: pivots, and of each block its cell, size and the angles to its own pivot and to the guides."""

    pivots: np.ndarray
    cell: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    guide_low: np.ndarray
    guide_high: np.ndarray

    def bounds(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector: the least possible angle to each block, and the angle to the block's pivot."""
        angle = _angles(u @ self.pivots.T)
        own = angle[:, self.cell]
        least = np.maximum(own - self.high, self.low - own)
        # a point of the cell is no nearer to the query's own pivot than to its own
        least = np.maximum(least, (own - angle.min(1, keepdims=True)) / 2)
        for g in range(self.guide_low.shape[1]):
            least = np.maximum(least, np.maximum(angle[:, [g]] - self.guide_high[:, g], self.guide_low[:, g] - angle[:, [g]]))
        return np.maximum(least - SLACK, 0.0), own


class PivotIndex:
    """points (vec_id, label, u) by block, as a table; all of them, exactly."""

    def __init__(self, points: DataFrame):
        spark = points.sparkSession
        whole = cut(points, "unit")
        n = whole.count()
        p = min(max(n // PER_PIVOT, PIVOTS[0]), PIVOTS[1])
        chosen = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "u").limit(p).select("u").toArrow()
        self.empty = not n
        if self.empty:
            return
        pivots = _rows(chosen.column(0))
        kind = whole.schema
        out = T.StructType([*kind.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
        names, place = out.names, whole.columns.index("u")

        def deal(batches):
            for batch in batches:
                if batch.num_rows:
                    cos = _rows(batch.column(place)) @ pivots.T
                    cell = cos.argmax(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(_angles(cos[np.arange(len(cell)), cell]))], names=names)

        dealt = cut(whole.mapInArrow(deal, out), "cells")
        discard(whole)
        shells = F.least(F.ceil(F.col("n") / SHELL), F.lit(SHELLS)).cast("int")
        cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", [i / SHELLS for i in range(1, SHELLS)], 1000).alias("q"))
        # every (SHELLS / shells)th of the 64ths
        edges = cells.select("cell", F.transform(F.sequence(F.lit(1), shells), lambda i: F.get("q", (i * SHELLS / shells).cast("int") - 1)).alias("edges"), shells.alias("shells"))
        edges = edges.select("cell", F.slice("edges", F.lit(1), F.col("shells") - 1).alias("edges"))
        shell = F.size(F.filter("edges", lambda e: e < F.col("angle")))
        self.points = cut(dealt.join(F.broadcast(edges), "cell").withColumn("block", F.col("cell") * SHELLS + shell).drop("edges", "cell"), "blocks")
        discard(dealt)
        guides = pivots[:GUIDES]
        at, of, own = (self.points.columns.index(c) for c in ("u", "block", "angle"))

        def spans(batches):
            seen: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                block, angle = np.asarray(batch.column(of)), np.asarray(batch.column(own))
                all_angles = np.column_stack((angle, _angles(_rows(batch.column(at)) @ guides.T)))
                for b in np.unique(block):
                    part = all_angles[block == b]
                    n, low, high = seen.get(b, (0, np.inf, -np.inf))
                    seen[b] = n + len(part), np.minimum(low, part.min(0)), np.maximum(high, part.max(0))
            rows = [(int(b), j, n, float(low[j]), float(high[j])) for b, (n, low, high) in seen.items() for j in range(len(low))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], names=["block", "j", "n", "low", "high"])

        found = self.points.mapInArrow(spans, "block int, j int, n long, low double, high double").groupBy("block", "j").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        got = found.orderBy("block", "j").toArrow()  # PIVOTS x SHELLS x (GUIDES + 1) rows at most
        wide = len(guides) + 1
        block, size, low, high = (np.asarray(got.column(c)).reshape(-1, wide) for c in ("block", "n", "low", "high"))
        self.ids = block[:, 0]
        self.blocks = Blocks(pivots, self.ids // SHELLS, size[:, 0], low[:, 0], high[:, 0], low[:, 1:], high[:, 1:])
        self.parts = spark.createDataFrame([(int(b), -(-int(s) // POINTS)) for b, s in zip(self.ids, self.blocks.size, strict=True)], "block int, parts int")

    def plan(self, queries: DataFrame, threshold: float, first: bool) -> DataFrame:
        """block, query_id, u, beat (the score that counts) of the blocks that a query (query_id, u, least) visits: the FIRST best ones, or all the others that its bounds leave.

        least is the score to beat, null where there is none but the threshold.
        """
        blocks, ids, kind = self.blocks, self.ids, queries.schema["query_id"].dataType

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, PIECE):
                    piece = batch.slice(at, PIECE)
                    least, own = blocks.bounds(_rows(piece.column(1)))
                    order = np.lexsort((own, least))
                    rank = np.empty_like(order)
                    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
                    beat = np.array([threshold if s is None else max(s, threshold) for s in piece.column(2).to_pylist()])
                    reach = least <= _angles(beat)[:, None] + SLACK
                    q, b = np.nonzero(reach & ((rank < FIRST) if first else (rank >= FIRST)))
                    take = pa.array(q)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[b].astype(np.int32)), piece.column(0).take(take), piece.column(1).take(take), pa.array(beat[q])], names=["block", "query_id", "u", "beat"])

        return queries.select("query_id", "u", "least").mapInArrow(run, T.StructType([T.StructField("block", T.IntegerType()), T.StructField("query_id", kind), T.StructField("u", T.BinaryType()), T.StructField("beat", T.DoubleType())]))

    def visit(self, planned: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, label, score: of each block and query the k best with the score that the query has to beat, or a higher one."""
        chunks = planned.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
        sizes = self.parts.join(chunks, "block")
        part = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = planned.join(F.broadcast(sizes), "block").withColumn("chunk", part(["query_id", "u"], "chunks")).withColumn("part", spread("parts")).select("block", "part", "chunk", "query_id", "u", "beat")
        held = self.points.join(F.broadcast(sizes), "block").withColumn("part", part(["vec_id", "u"], "parts")).withColumn("chunk", spread("chunks")).select("block", "part", "chunk", "vec_id", "label", "u")
        out = T.StructType([asked.schema["query_id"], held.schema["vec_id"], held.schema["label"], T.StructField("score", T.DoubleType())])

        def meet(asked, held):
            if not asked.num_rows or not held.num_rows:
                return pa.table({f.name: pa.array([], t) for f, t in zip(out, (asked.schema.field("query_id").type, held.schema.field("vec_id").type, held.schema.field("label").type, pa.float64()), strict=True)})
            q, x, beat = _rows(asked.column("u")), _rows(held.column("u")), asked.column("beat").to_pylist()
            ids = held.column("vec_id").to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])))
            x = x[order]
            first, second, scores = [], [], []
            for at in range(0, len(q), PIECE):
                near = q[at : at + PIECE] @ x.T
                for i in range(len(near)):
                    row = near[i]
                    floor = beat[at + i] - 1e-9
                    if len(row) > k:  # all that may be among the k best, rounding aside
                        floor = max(floor, np.partition(row, len(row) - k)[len(row) - k] - 1e-9)
                    cand = np.flatnonzero(row >= floor)
                    exact = (x[cand] * q[at + i]).sum(1)  # the same sum for equal vectors, wherever they stand
                    keep = np.argsort(-exact, kind="stable")[:k]
                    keep = keep[exact[keep] >= beat[at + i]]
                    first += [at + i] * len(keep)
                    second += order[cand[keep]].tolist()
                    scores += exact[keep].tolist()
            a, b = pa.array(first, pa.int64()), pa.array(second, pa.int64())
            return pa.table({"query_id": asked.column("query_id").take(a), "vec_id": held.column("vec_id").take(b), "label": held.column("label").take(b), "score": pa.array(scores, pa.float64())})

        keys = ["block", "part", "chunk"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, out)


def nearest_by_pivots(points: DataFrame, queries: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """hits: query_id, vec_id, label, score, rank as retrieval.nearest has them. visits: query_id, pairs: how many points each query met.

    points (vec_id, label, embedding), queries (query_id, q). Exact: a block is skipped only
    if the angle to all its points is larger than that of the k-th hit so far, or than the
    threshold's. Vectors without a direction (null, zero, with nulls or no numbers) match nothing.
    """
    index = PivotIndex(unit_vectors(points.select("vec_id", "label", "embedding"), "embedding"))
    asked = cut(unit_vectors(queries.where("query_id is not null").select("query_id", "q"), "q"), "queries")
    if index.empty:
        none = points.select("vec_id", "label").where(F.lit(False)).crossJoin(asked.select("query_id").where(F.lit(False)))
        return none.select("query_id", "vec_id", "label", F.lit(0.0).alias("score"), F.lit(0).alias("rank")), asked.select("query_id", F.lit(0).cast("long").alias("pairs"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = cut(index.plan(asked.withColumn("least", F.lit(None).cast("double")), threshold, True), "first")
    hits = cut(index.visit(first, k), "hits")
    beat = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("least"))
    rest = cut(index.plan(asked.join(beat, "query_id", "left").select("query_id", "u", "least"), threshold, False), "rest")
    found = hits.unionByName(index.visit(rest, k))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    sizes = index.points.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    visits = first.select("block", "query_id").union(rest.select("block", "query_id")).join(F.broadcast(sizes), "block").groupBy("query_id").agg(F.sum("n").alias("pairs"))
    return ranked, visits
