"""Near-duplicate texts by a chosen-path similarity join on minwise signatures.

Texts with one shingle set form a class; everything after the first pass works on classes. Independent trees branch
the classes by selected coordinates of their signatures: classes that agree on a coordinate share a node. Pairs of Jaccard
similarity 0.75 miss each other at the first level of all ``TREES`` trees with probability 0.25 ** TREES.

1. In every node each class is paired with the node's first one. Pairs whose signatures agree enough are verified on the
   full sets, and links make components. Near copies by the thousand need one pair each for that.
2. Only pairs of different components can still add links. Nodes of one component are done. A node that holds more than
   ``NODE`` classes beside its largest component branches again by one more coordinate, chosen by its name, down to
   ``DEPTH`` coordinates: a pair of the least similarity shares a path of d coordinates in none of the trees with
   probability (1 - 0.75 ** d) ** TREES, that is 0.2 % at the greatest depth, which only pairs in large nodes reach. In
   nodes that branch no more the signatures of all pairs across components are compared, in a grid of chunks, so that no
   task holds more than two chunks of any node; what leaves a cell is not its candidate pairs but a forest that connects
   them, a row for each class at most.
3. Forests of all trees join into families, which hold every candidate pair once, whatever the number of trees that found
   it. In the same grid, full sets of a family's members are compared for all its candidate pairs across components that
   earlier links of the cell do not connect already. These links and those of step 1 give the final components.

Verification reads the texts again, only for classes in candidate pairs (chosen by a bitmap of fixed size and then by a
join). Links are confirmed on the full sets; hashes have 64 bits.

Texts without words link with nothing, null texts likewise; their component is their own id. Rows that share an id or
repeat are separate members of classes. Null ids never name a component that has another id; ``kept`` compares null-safe.
Texts are read whole, however long; an empty table gives an empty result; other columns may have any names, as only the
text and the id are read. Texts whose sets have one 128-bit digest count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, shingles
from quarry.llm.components import connected

#: Trees, classes beside the largest component that a node may hold without branching, greatest depth, rows in a chunk.
TREES, NODE, DEPTH, CHUNK = 16, 64, 4, 500
#: Signatures that agree on fewer coordinates are no candidates: at similarity 0.75 that is 4.6 standard deviations off.
AGREE = 32
#: Bits of the bitmap that preselects texts to read again.
BITMAP = 1 << 24


def signed(df: DataFrame, width: int) -> DataFrame:
    """(doc_id, rk, n, ck, sig) for each row: content key, set size, set digest, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ck, sig = [], [], []
            for part in shingles.chunks(batch.column(2)):
                for s in shingles.sets(part, width):
                    n.append(len(s))
                    ck.append(shingles.digest(s))
                    sig.append(shingles.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ck, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "rk", "n", "ck", "sig"])

    return df.mapInArrow(run, "doc_id bigint, rk bigint, n bigint, ck binary, sig binary")


def needed_sets(df: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(rk, hashes) of the texts whose content key is in ``needed`` (rk)."""
    spark = df.sparkSession
    bit = F.pmod("rk", F.lit(BITMAP)) + 1  # the functions count from 1
    parts = needed.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()  # at most 512 rows of 4 kB
    bits = np.zeros(BITMAP // 8 + 8192, dtype=np.uint8)
    for r in parts:
        at = (r.k - 1) * 4096
        bits[at : at + len(r.m)] = np.frombuffer(r.m, dtype=np.uint8)
    bitmap = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk = batch.column(1).to_numpy()
            b = np.mod(rk, BITMAP)
            # bucket k holds bits (k - 1) * 32768 to k * 32768 - 1 counted from bit 0
            hit = (bitmap.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
            some = batch.filter(pa.array(hit))
            keys = some.column(1).to_pylist()
            out = [s.tobytes() for part in shingles.chunks(some.column(2)) for s in shingles.sets(part, width)]
            for at in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 500], pa.int64()), pa.array(out[at : at + 500], pa.binary())], names=["rk", "hashes"])

    found = df.mapInArrow(run, "rk bigint, hashes binary")
    return found.join(needed, "rk", "left_semi")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose signatures agree enough, from (a, b, sig of a, sig of b)."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def verified(df: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of content keys whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("rk")).union(pairs.select(F.col("b").alias("rk"))).distinct()
    held = common.written(needed_sets(df, ends, width).dropDuplicates(["rk"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    left = pairs.join(held.select(F.col("rk").alias("a"), F.col("hashes").alias("x")), "a")
    full = left.join(held.select(F.col("rk").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    out = common.written(full.mapInArrow(run, "a bigint, b bigint"), "links")
    common.release(held)
    return out


def _cells(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work(rows)`` for the rows of each cell, from batches sorted by cell; a cell's rows may span batches."""
    waiting: list = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if waiting and row[0] != waiting[0][0]:
                if len(waiting) > 1:
                    yield work(waiting)
                waiting = []
            waiting.append(row)
    if len(waiting) > 1:
        yield work(waiting)


def _candidates(rows: list) -> np.ndarray:
    """How many coordinates the rows of a cell agree on, 0 for pairs that the cell does not compare."""
    side, comp = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 3))
    sig = np.frombuffer(b"".join([r[4] for r in rows]), dtype=np.uint32).reshape(len(rows), -1)
    agree = np.zeros((len(rows), len(rows)), dtype=np.uint8)
    for k in range(sig.shape[1]):
        agree += sig[:, k][:, None] == sig[:, k][None, :]
    compared = (comp[:, None] != comp[None, :]) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))
    return np.where(compared & (agree >= AGREE), agree, 0)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _family(rows: list) -> pa.RecordBatch:
    """(a, b): each row of a cell that has candidates, with the smallest row that candidates reach from it."""
    near = _candidates(rows) > 0
    rk = np.array([r[2] for r in rows], dtype=np.int64)
    least = rk
    while True:
        new = np.minimum(least, np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == least).all():
            break
        least = new
    at = np.flatnonzero(near.any(axis=1) & (least != rk))
    return _edges(least[at].tolist(), rk[at].tolist())


def _confirmed(percent: int):
    def work(rows: list) -> pa.RecordBatch:
        """Links across components, confirmed on full sets; pairs that links connect already are passed over."""
        agree = np.triu(_candidates(rows), 1)
        x, y = np.nonzero(agree)
        order = np.argsort(-agree[x, y].astype(int), kind="stable")
        sets = [np.frombuffer(r[5], dtype=np.uint64) for r in rows]
        ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([len(s) for s in sets])[:-1])
        marks = np.zeros(max(len(i) and int(i.max()) + 1 for i in ids), dtype=bool)
        parent = {r[3]: r[3] for r in rows}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for i, j in zip(x[order], y[order], strict=True):
            u, v = root(rows[i][3]), root(rows[j][3])
            if u != v:
                marks[ids[i]] = True
                both = int(marks[ids[j]].sum())
                marks[ids[i]] = False
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(u, v)] = min(u, v)
                    a.append(rows[i][2])
                    b.append(rows[j][2])
        return _edges(a, b)

    return work


def gridded(members: DataFrame, nodes: DataFrame, more: DataFrame, work) -> DataFrame:
    """(a, b) that ``work`` gives for cells that hold all pairs across components of the nodes between them.

    Members are (node, rk, comp), nodes (node, main, n_main, n_rest); ``more`` has what ``work`` needs for each rk.

    The members of a node's largest component and the rest are cut into chunks of CHUNK rows. A cell of the grid holds a
    chunk of the largest component and one of the rest, or two chunks of the rest.
    """
    m = F.greatest(F.ceil(F.col("n_main") / CHUNK), F.lit(1))
    r = F.greatest(F.ceil(F.col("n_rest") / CHUNK), F.lit(1))
    dealt = members.join(nodes.select("node", "main", m.alias("m"), r.alias("r")), "node")
    big = F.col("comp") == F.col("main")
    own = F.when(big, F.pmod(F.xxhash64("rk"), F.col("m"))).otherwise(F.pmod(F.xxhash64("rk"), F.col("r")))
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # cells: ("m", chunk of the largest, chunk of the rest) and ("r", lower chunk of the rest, higher one)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("t"), i.alias("i"), j.alias("j"), F.lit(side).cast("bigint").alias("side"))
    with_rest = F.transform(numbers(F.col("r")), lambda j: cell("m", F.col("own"), j, 0))
    with_main = F.transform(numbers(F.col("m")), lambda i: cell("m", i, F.col("own"), 1))
    among = F.transform(numbers(F.col("r")), lambda j: F.when(j < F.col("own"), cell("r", j, F.col("own"), 1)).when(j > F.col("own"), cell("r", F.col("own"), j, 0)).otherwise(cell("r", j, j, 2)))
    cells = dealt.withColumn("own", own).withColumn("big", big).select("node", "rk", "comp", F.explode(F.when(F.col("big"), with_rest).otherwise(F.concat(with_main, among))).alias("c"))
    extra = [c for c in more.columns if c != "rk"]
    keyed = cells.select(F.xxhash64("node", "c.t", "c.i", "c.j").alias("cell"), "c.side", "rk", "comp").join(more, "rk")
    ordered = keyed.select("cell", "side", "rk", "comp", *extra).repartition("cell").sortWithinPartitions("cell", "rk")
    return ordered.mapInArrow(lambda batches: _cells(batches, work), "a bigint, b bigint")


def branched(members: DataFrame, sigs: DataFrame, depth: int) -> DataFrame:
    """Children (node, rk, comp) by one more coordinate for each node, chosen by its name among those no tree begins with."""
    pick = F.pmod(F.xxhash64(F.lit(depth), "node"), F.lit(shingles.COORDINATES - TREES)) + TREES
    child = F.xxhash64("node", pick, F.substring("sig", (pick * 4 + 1).cast("int"), F.lit(4)))
    return members.join(sigs, "rk").select(child.alias("node"), "rk", "comp")


def mixed_nodes(members: DataFrame) -> DataFrame:
    """(node, main, n_main, n_rest) of the nodes that hold several components."""
    each = members.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = each.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps"))
    return top.where("comps > 1").select("node", F.col("top.comp").alias("main"), F.col("top.n").alias("n_main"), (F.col("all") - F.col("top.n")).alias("n_rest"))


def components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, kept) for each row; rk is the content key of id and text."""
    common.worker_imports(df.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(doc_id), t).alias("rk"), t.alias("text"))
    rows = common.written(signed(base, width), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rk"))
    classes = common.written(rows.where("n > 0").groupBy("ck").agg(least.alias("r"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("size")).select("ck", "r.doc_id", "r.rk", "sig", "size"), "classes")
    sigs = classes.select("rk", "sig")

    value = lambda k: F.xxhash64(F.lit(k), F.substring("sig", 4 * k + 1, 4))
    first = classes.select("rk", F.explode(F.array(*[value(k) for k in range(TREES)])).alias("node"))
    nodes = first.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("rk").alias("pivot")).where("n > 1")
    active = common.written(first.join(nodes.select("node", "pivot"), "node"), "nodes")

    stars = active.where("rk != pivot").select(F.col("pivot").alias("a"), F.col("rk").alias("b")).distinct()
    stars = stars.join(sigs.select(F.col("rk").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("rk").alias("b"), F.col("sig").alias("y")), "b")
    stars = common.written(stars.select("a", "b", "x", "y").mapInArrow(_alike, "a bigint, b bigint"), "stars")
    links = verified(base, stars, width, percent)
    labels = connected(links)

    with_comp = active.select("node", "rk").join(labels.withColumnRenamed("v", "rk"), "rk", "left").select("node", "rk", F.coalesce("label", "rk").alias("comp"))
    members = common.written(with_comp, "members")
    found = None
    for depth in range(1, DEPTH + 1):
        several = common.written(mixed_nodes(members), "several")
        last = depth == DEPTH
        small = several if last else several.where(F.col("n_rest") <= NODE)
        near = common.written(gridded(members, small, sigs, _family), "near")
        found = near if found is None else found.union(near)
        large = several.where(F.col("n_rest") > NODE)
        if last or not large.limit(1).count():
            break
        members = common.written(branched(members.join(large.select("node"), "node", "left_semi"), sigs, depth), "members")
    if found.limit(1).count():
        families = connected(found).toDF("rk", "node")
        members = common.written(families.join(labels.toDF("rk", "label"), "rk", "left").select("node", "rk", F.coalesce("label", "rk").alias("comp")), "members")
        held = common.written(needed_sets(base, members.select("rk"), width).dropDuplicates(["rk"]), "sets")
        more = common.written(gridded(members, mixed_nodes(members), sigs.join(held, "rk"), _confirmed(percent)), "more")
        labels = connected(links.union(more)) if more.limit(1).count() else labels

    named = classes.select("ck", "doc_id", "rk", "size").join(labels.withColumnRenamed("v", "w"), F.col("rk") == F.col("w"), "left").select("ck", "doc_id", "size", F.coalesce("label", "rk").alias("comp"))
    linked = labels.groupBy("label").agg(F.count(F.lit(1)).alias("c")).select("label")
    smallest = named.join(linked, F.col("comp") == F.col("label"), "left_semi").groupBy("comp").agg(F.min("doc_id").alias("smallest"))
    moved = named.join(smallest.withColumnRenamed("comp", "w"), F.col("comp") == F.col("w"), "left").where(F.col("size").__gt__(1) | F.col("w").isNotNull()).select("ck", F.when(F.col("w").isNotNull(), F.col("smallest")).otherwise(F.col("doc_id")).alias("target"), F.lit(True).alias("moved"))
    moved = common.written(moved, "moved")
    out = common.bounded_join(rows.select("doc_id", "rk", "n", "ck"), moved, ["ck"])
    component = F.when(F.col("moved") & (F.col("n") > 0), F.col("target")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without those that a document of a smaller id makes superfluous; columns stay."""
    key, may = common.fresh(docs, "_rk", "_may")
    gone = common.written(components(docs).where("not kept").select(F.col("rk").alias(key)).distinct(), "gone")
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = common.marked(docs.withColumn(key, F.xxhash64(F.col("doc_id"), t)), key, gone, may)
    left = keyed.where(may).join(gone.hint("merge"), key, "left_anti")
    return keyed.where(~F.col(may)).select(*docs.columns).unionByName(left.select(*docs.columns))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
