"""Pieces that several corpus operators share: the shared folder, written tables, ordered buckets, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and \x09-\x0D; bytes.split() cuts UTF-8 at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, set here only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="vasculyze-")
        shared_dir.local = folder
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: it cuts the lineage and survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vasculyze/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and forgets what made them."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    for df in tables[:1]:
        forget(df.sparkSession)


def forget(spark: SparkSession) -> None:
    """Spark keeps shuffles and broadcasts of finished steps until the driver happens to collect its garbage: here it does."""
    gc.collect()
    spark._jvm.System.gc()


def crc32_of(col) -> F.Column:
    """crc32 of a number's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_buckets(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most `buckets` increasing keys that occur in df, the smallest first: each begins a bucket of nearly equal row count.

    Only the key column is read; what reaches the driver is bounded by `buckets`. Null keys don't count.
    """
    shares = [i / buckets for i in range(buckets)]
    row = df.agg(F.min(key).alias("least"), F.percentile_approx(key, shares, 100 * buckets).alias("at")).head()
    if row is None or row["least"] is None:
        return []
    return sorted({row["least"], *(x for x in row["at"] if x is not None)})


def bucket_of(key, starts: list[int]) -> F.Column:
    """(number of a key's bucket, whether the key begins it) as a struct; null keys go to the last, where they come last.

    The search is of two steps over about the square root of the starts each.
    """
    if not starts:
        return F.struct(F.lit(0).alias("no"), F.lit(False).alias("first"))
    step = max(1, int(len(starts) ** 0.5))
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.greatest(F.lit(0), F.size(F.filter(xs, lambda b: b <= key)) - 1)
    part = below(long(starts[::step]))
    within = F.get(F.array(*[long(starts[a : a + step]) for a in range(0, len(starts), step)]), part)
    no, first = (part * step + below(within)).cast("int"), F.array_contains(within, key)
    return F.when(key.isNull(), F.struct(F.lit(len(starts) - 1).alias("no"), F.lit(False).alias("first"))).otherwise(F.struct(no.alias("no"), first.alias("first")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts reach Python workers in batches of at most so many rows: a batch's memory is bounded by rows times text length."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, rows)


def release() -> None:
    """Gives memory that Arrow and the C library hold back to the system; idle workers live on beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_KEPT: dict[str, object] = {}


def kept(kind: str, make):
    """What `make` gives, kept by this Python worker for its next tasks of the same kind."""
    if kind not in _KEPT:
        _KEPT[kind] = make()
    return _KEPT[kind]


def let_go(kind: str = "") -> None:
    """Throws away what the worker keeps for tasks of other kinds: workers are shared by all steps of a job."""
    others = [k for k in _KEPT if not kind or not k.startswith(kind)]
    for k in others:
        del _KEPT[k]
    if others:
        release()


def tidy(run, kind: str = ""):
    """A mapInArrow function that keeps no other kind's objects, and releases its memory when its task ends."""

    def inner(batches):
        let_go(kind)
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def together(batches, rows: int):
    """Arrow batches joined until they have so many rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Links that a task joins up at once.
HELD_LINKS = 1_500_000
#: A node with more than one part in so many of a link table's rows is a hub; both directions of E links have fewer than 2 * HUBS of them.
HUBS = 256


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these links reach) for every node but the least ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(i):
        # Labels are roots here: the larger root of a link points to the least that any of its links offers.
        m = np.minimum(least[i], least[j])
        np.minimum.at(least, np.maximum(least[i], least[j]), m)
        while not np.array_equal(jumped := least[least], least):
            least = jumped
        apart = least[i] != least[j]
        i, j = i[apart], j[apart]
    child = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[child], nodes[least[child]]


def _joined_up(batches):
    """Links (u, v) -> (u, v), v the least node that the task's links reach from u: at most one row a node and HELD_LINKS links."""
    held, n = [], 0

    def rows():
        u, v = forest(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        for x in range(0, len(u), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[x : x + 200_000]), pa.array(v[x : x + 200_000])], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= HELD_LINKS:
            yield from rows()
            held, n = [], 0
    if held:
        yield from rows()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links, component being the least node that links reach.

    Tasks join up the links that they hold, so a node comes out of each with one row at most; then links meet by their larger
    node and are joined up again, until the table is a forest of stars. Between two such steps the large-star rule links every
    node's larger neighbours to its least one, with hubs' rows joined by a bounded broadcast instead of a shuffle. Each round is
    a written table, and the one before is deleted. Nothing but a flag a round reaches the driver.
    """
    schema = "u bigint, v bigint"
    links = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").mapInArrow(tidy(_joined_up), schema)
    e = written(links.repartition("u").mapInArrow(tidy(_joined_up), schema), "links")
    for _ in range(most_rounds):
        # A forest of stars: no node has two rows, and none that others point to points on.
        ends = e.select("u", F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("n")))
        ends = ends.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("pointed"))
        if ends.where("n > 1 or (n = 1 and pointed = 0)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = e.count()
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = F.broadcast(least.where(F.col("n") * HUBS > n).select("u", "m"))
        few = both.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") * HUBS <= n).select("u", "m"), "u")
        large = few.unionByName(both.join(hubs, "u")).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        last, e = e, written(large.repartition("u").mapInArrow(tidy(_joined_up), schema), "links")
        drop(last)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def running_total(df: DataFrame, groups: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all earlier rows in the order (groups, order), exclusive; a window per group plus one over group sums."""
    w = Window.orderBy(groups).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(groups).agg(F.sum(value).alias("_s")).select(groups, F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    v = Window.partitionBy(groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, groups).withColumn(name, (F.col("_base") + F.coalesce(F.sum(value).over(v), F.lit(0))).cast("long")).drop("_base")
