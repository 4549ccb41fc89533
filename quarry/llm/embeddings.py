"""Embedding near-dedup by counting collisions of one-dimensional projections.

Vectors of one label are projected on many random directions. Two vectors collide in a projection if one lies in the
window around the other. For a pair at the least cosine the difference of projections has a known spread, which gives the
probability of a collision, and from the binomial distribution the number of collisions that such pairs reach with the
recall asked for. Pairs that reach it are verified by their cosine in double precision.

Equal vectors of a label are one class. Classes are sorted by label and by the slabs that they lie in along one projection
after the other, and cut into blocks, so a block is narrow in as many projections as its label has rows for. Blocks meet
by the slabs of the first projection; two of them are compared unless their ranges lie further apart, in any projection,
than any pair's should (a chance of 1e-5), or are apart in more projections than the count allows. Within a pair of
blocks each projection is sorted, and the window around each query there gives the collisions of its pairs. A task holds
two blocks at a time and returns, for each vector, how many vectors it links with there and the smallest vector that links
reach there, but no pairs, so a group of near copies costs rows in proportion to its size.

Vectors that are null, zero or hold null or non-finite components, and rows with null labels, link with nothing; they
are their own component. Vectors of different lengths do not link. Rows with one id are each counted, and share the
component of the smallest; null ids name no component. An empty table gives an empty result. Vectors may be long: a block
of 1000 is held twice. Other columns may have any names, as only the three that are named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import connected

#: Least cosine, number of projections, half a window in standard deviations, share of pairs that the count may miss.
COSINE, PROJECTIONS, WINDOW, MISS = 0.98, 24, 2.0, 1e-5
#: Rows in a block; half width, in standard deviations of a pair's difference, of the range that blocks are compared over;
#: width of slabs, in those of the projections of unit vectors; projections that the order of rows is made from.
BLOCK, REACH, SLAB, ORDERED = 1000, 5.0, 0.5, 8


def needed_collisions(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest count that a pair at the least cosine reaches but for the given share."""
    p = erf(window / sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


def spread(dim: int, cosine: float = COSINE) -> float:
    """Standard deviation of the difference of projections on a random unit vector, for a pair at the least cosine."""
    return sqrt(max(2 - 2 * cosine, 0.0) / dim)


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    d = np.random.default_rng(dim).standard_normal((dim, projections))
    return d / np.linalg.norm(d, axis=0)


def projected(classes: DataFrame) -> DataFrame:
    """(id, label, dim, size, unit, p) from classes (id, label, size, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, p, dims = [], [], []
            for v in batch.column(3):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x / np.abs(x).max()
                x = x / np.sqrt((x * x).sum())
                unit.append(x)
                p.append(x @ directions(len(x)))
                dims.append(len(x))
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), batch.column(2), pa.array(unit, doubles), pa.array(p, doubles)], names=["id", "label", "dim", "size", "unit", "p"])

    return classes.mapInArrow(run, "id bigint, label string, dim int, size bigint, unit array<double>, p array<double>")


def _linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, need: int, cosine: float) -> np.ndarray:
    """Which rows of x and y are similar enough: first enough collisions, then the cosine."""
    width = WINDOW * spread(x.shape[1], cosine)
    hits = np.zeros((len(x), len(y)), dtype=np.int8)
    row = np.arange(len(x))
    for j in range(px.shape[1]):
        order = np.argsort(py[:, j], kind="stable")
        line = py[order, j]
        edges = np.zeros((len(x), len(y) + 1), dtype=np.int8)  # 1 where a query's window begins, -1 where it ends
        edges[row, np.searchsorted(line, px[:, j] - width, side="left")] += 1
        edges[row, np.searchsorted(line, px[:, j] + width, side="right")] -= 1
        hits[:, order] += np.cumsum(edges[:, :-1], axis=1, dtype=np.int8)
    passed = hits >= need
    if passed.mean() > 0.02:
        return passed & (x @ y.T >= cosine)
    a, b = np.nonzero(passed)
    passed[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
    return passed


def _cell(rows: dict[str, np.ndarray], need: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, links and smallest reachable id of the rows of a pair of blocks that link at all."""
    side = rows["side"]
    one = side[0] == 2
    left = np.arange(len(side)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    none = np.zeros(0, np.int64)
    if len(left) == 0 or len(right) == 0:
        return none, none, none
    linked = _linked(rows["unit"][left], rows["unit"][right], rows["p"][left], rows["p"][right], need, cosine)
    if one:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return none, none, none
    ids, size = rows["id"], rows["size"]
    a, b = ids[left].copy(), ids[right].copy()
    far = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], far).min(axis=1))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], far).min(axis=0))
        if one:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    links_a, links_b = linked @ size[right], linked.T @ size[left]
    some_a = linked.any(axis=1)
    if one:
        return ids[left][some_a], links_a[some_a], a[some_a]
    some_b = linked.any(axis=0)
    return np.concatenate([ids[left][some_a], ids[right][some_b]]), np.concatenate([links_a[some_a], links_b[some_b]]), np.concatenate([a[some_a], b[some_b]])


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    lists = lambda k: batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1)
    plain = lambda k: batch.column(k).to_numpy()
    return {"cell": plain(0), "side": plain(1), "id": plain(2), "size": plain(3), "unit": lists(4), "p": lists(5)}


def partial_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(id, links, least): for the classes of each pair of blocks what they link with there."""
    need = needed_collisions()
    slab = lambda p, dim: F.floor(p * F.sqrt(dim) / SLAB).cast("int")  # noqa: E731 - unit vectors' projections have a deviation of 1/sqrt(dim)
    order = ["label", "dim", *[slab(F.get("p", F.lit(j)), F.col("dim")) for j in range(ORDERED)], F.get("p", F.lit(ORDERED)), "id"]
    ordered = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    blocked = common.written(ordered.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}")), "vectors")
    low = [F.min(F.get("p", F.lit(j))).alias(f"l{j}") for j in range(PROJECTIONS)]
    high = [F.max(F.get("p", F.lit(j))).alias(f"h{j}") for j in range(PROJECTIONS)]
    blocks = blocked.groupBy("label", "dim", "block").agg(*low, *high)
    blocks = common.written(blocks.select("label", "dim", "block", F.array(*[f"l{j}" for j in range(PROJECTIONS)]).alias("low"), F.array(*[f"h{j}" for j in range(PROJECTIONS)]).alias("high")), "blocks")
    sd = F.sqrt(F.lit(max(2 - 2 * cosine, 0.0)) / F.col("dim"))
    # a block meets another by the first slab that both touch, the one widened by what a pair may differ
    mine = blocks.withColumn("s0", slab(F.get("low", F.lit(0)), F.col("dim"))).withColumn("slab", F.explode(F.sequence("s0", slab(F.get("high", F.lit(0)), F.col("dim")))))
    wide = blocks.select(*[F.col(c).alias(f"{c}2") for c in blocks.columns], slab(F.get("low", F.lit(0)) - REACH * sd, F.col("dim")).alias("s2"), slab(F.get("high", F.lit(0)) + REACH * sd, F.col("dim")).alias("e2"))
    wide = wide.withColumn("slab2", F.explode(F.sequence("s2", "e2")))
    met = (F.col("label") == F.col("label2")) & (F.col("dim") == F.col("dim2")) & (F.col("slab") == F.col("slab2")) & (F.col("slab") == F.greatest("s0", "s2")) & (F.col("block") <= F.col("block2"))
    gaps = F.zip_with(F.zip_with("low2", "high", lambda a, b: a - b), F.zip_with("low", "high2", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    pairs = mine.join(wide, met).withColumn("gaps", gaps)
    pairs = pairs.where((F.array_max("gaps") <= REACH * sd) & (F.size(F.filter("gaps", lambda g: g > WINDOW * sd)) <= PROJECTIONS - need))
    pairs = pairs.select("label", "dim", "block", "block2", F.xxhash64("label", "dim", "block", "block2").alias("cell"))
    same = F.col("block") == F.col("block2")
    sides = pairs.select("label", "dim", "block", "cell", F.when(same, 2).otherwise(0).alias("side")).union(pairs.where(~same).select("label", "dim", "block2", "cell", F.lit(1)))
    dealt = blocked.join(sides, ["label", "dim", "block"]).select("cell", "side", "id", "size", "unit", "p").repartition("cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            got = _cell({k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, need, cosine)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in got], names=["id", "links", "least"])

        waiting: list[dict[str, np.ndarray]] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                part = _columns(batch.slice(low, high - low))
                if waiting and waiting[0]["cell"][0] != part["cell"][0]:
                    yield result(waiting)
                    waiting = []
                waiting.append(part)
        if waiting:
            yield result(waiting)

    return common.written(dealt.mapInArrow(run, "id bigint, links bigint, least bigint"), "partial")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    common.worker_imports(df.sparkSession)
    e = F.col(embedding).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.col(label).isNotNull() & F.col(embedding).isNotNull() & F.coalesce(F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.transform(e, lambda x: x + F.lit(0.0)).alias("embedding"), valid.alias("valid"))
    key = F.when(F.col("valid"), F.xxhash64("label", "embedding"))
    rows = rows.withColumn("k", key)
    good = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("size"))
    classes = common.written(good.withColumn("id", F.xxhash64("label", "embedding")), "classes")
    partial = partial_links(projected(classes.select("id", "label", "size", "embedding")), cosine)
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    labels = connected(partial.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    named = classes.select("id", "least_id", "size").join(labels.withColumnRenamed("v", "id"), "id", "left").join(links, "id", "left")
    named = named.select("id", "least_id", F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("label", "id")).toDF("id", "least_id", "n_links", "comp")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    moved = named.where("n_links > 0").join(least, "comp").select(F.col("id").alias("k"), "n_links", "component_id", F.lit(True).alias("moved"))
    out = common.bounded_join(rows.select("vec_id", "k"), common.written(moved, "moved"), ["k"])
    component = F.when(F.col("moved"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
