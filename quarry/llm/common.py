"""What the corpus operators share: written intermediate tables, worker imports and column helpers."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"

_local_dir: str | None = None
_written: dict[str, tuple[SparkSession, str]] = {}
_shipped: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder.
    """
    global _local_dir
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="quarry-")
    return f"file://{_local_dir}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = (spark, tag)
    out = spark.read.schema(df.schema).parquet(path)
    out.quarry_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session may have ended
        pass


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "quarry_path", None)
        if path in _written:
            delete(_written.pop(path)[0], path)


def paths() -> set[str]:
    """The tables of :func:`written` that are still there."""
    return set(_written)


def release_paths(some: set[str]) -> None:
    """Delete these tables of :func:`written`."""
    for path in some:
        if path in _written:
            delete(_written.pop(path)[0], path)


def release_all() -> None:
    """Delete every table of :func:`written`; call it once the results that read them are stored."""
    while _written:
        path, (spark, _) = _written.popitem()
        delete(spark, path)


@atexit.register
def _at_exit() -> None:
    release_all()
    if _local_dir:
        import shutil

        shutil.rmtree(_local_dir, ignore_errors=True)


def worker_imports(spark: SparkSession) -> None:
    """Let Python workers import this package: from the driver's path in local mode, else from an archive that Spark ships."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if sc.master == "local" or sc.master.startswith("local["):
        root, have = os.path.dirname(package), sc.environment.get("PYTHONPATH", "")
        if root not in have.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    elif _shipped.get("to") != sc.applicationId:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}.zip")
        out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(held.getvalue()))
        out.close()
        sc.addPyFile(place.toString())
        _shipped["to"] = sc.applicationId


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, even where lambdas refer to it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    """The text column as string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between white space, in order; no empty ones."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table does not have yet."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Left join of many rows with a table of distinct keys, each hot key dealt over ``salts`` tasks. Null keys match."""
    salt, *right_keys = fresh(left, "_salt", *[f"_key_{k}" for k in keys])
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if left.schema[c].dataType.typeName() != "map"]), F.lit(salts)).cast("int"))
    copies = right.select(*[F.col(k).alias(r) for k, r in zip(keys, right_keys, strict=True)], *[c for c in right.columns if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(f"{salt}r"))
    same = F.col(salt) == F.col(f"{salt}r")
    for k, r in zip(keys, right_keys, strict=True):
        same = same & dealt[k].eqNullSafe(copies[r])
    return dealt.join(copies, same, "left").drop(salt, f"{salt}r", *right_keys)


#: Most rows of a table of fixed-width rows that is broadcast; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 20_000


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a written table of distinct keys: broadcast if its checked row count is small, salted otherwise."""
    if right.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return salted_join(left, right, keys)
    names = fresh(left, *[f"_key_{k}" for k in keys])
    small = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & left[k].eqNullSafe(small[n])
    return left.join(F.broadcast(small), same, "left").drop(*names)


def numbered(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """Add 0, 1, 2, ... in the given order, without bringing the rows into one task.

    Rows are dealt out by ranges and written; what is summed over all partitions is one count for each of them.
    """
    place, part, before = fresh(df, "_place", "_part", "_before")
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "numbered")
    held = F.shiftright(place, 33).alias(part)
    counts = rows.groupBy(held).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))  # a row for each partition
    joined = rows.join(F.broadcast(starts), F.shiftright(place, 33) == F.col(part))
    return joined.withColumn(out, F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).drop(place, part, before)


#: Bits of the bitmap of :func:`marked`: at most 512 rows of 4 kB.
MARK_BITS = 1 << 24


def marked(df: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """Add whether a row's key (a long) may be among ``keys`` (one column): false is sure, true nearly so.

    A bitmap of fixed size is broadcast, so rows that have no match need no shuffle to find that out.
    """
    bit = lambda c: F.pmod(c, F.lit(MARK_BITS)) + 1
    maps = keys.select(bit(F.col(keys.columns[0])).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_bk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bm"))
    at = F.bitmap_bit_position(bit(F.col(key)))
    joined = df.join(F.broadcast(written(maps, "bitmap")), F.bitmap_bucket_number(bit(F.col(key))) == F.col("_bk"), "left")
    byte = F.conv(F.hex(F.substring("_bm", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    flag = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return joined.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_bk", "_bm")
