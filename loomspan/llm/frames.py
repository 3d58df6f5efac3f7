"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a local one if all runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomspan-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def row_tag(spark: SparkSession) -> Column:
    """A number for each row of a table that is read, alike each time it is read in this session.

    The number has the row's place in its split, so splits must not change
    between two readings.  By default they follow the number of cores, which
    changes as executors come and go; it is fixed here at what it is now.
    """
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))
    return F.monotonically_increasing_id()


def unused(df: DataFrame, name: str) -> str:
    """name, or one made of it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fixed(docs: DataFrame) -> DataFrame:
    """docs itself if its rows come alike and in the same splits each time: a plain read of files; else a copy in the shared folder."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    node = plan
    while node.nodeName() in ("Project", "Filter") and node.children().size() == 1:
        node = node.children().head()
    return docs if node.nodeName() == "LogicalRelation" and plan.deterministic() else keep(docs)


def tagged(docs: DataFrame) -> DataFrame:
    """docs with row_tag long, a number for each row, the same each time the result is computed."""
    docs = fixed(docs)
    return docs.withColumn("row_tag", row_tag(docs.sparkSession))


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, which Spark deletes once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let executors give memory that finished steps took back to the system; where all runs in one process, tidy() does.

    A heap that a step has stretched stays as large, beside the workers of
    the next; only a full collection shrinks it.  Costs some tenths of a second.
    """
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        collect_in_tasks(spark)


def collect_in_tasks(spark: SparkSession) -> None:
    """A full collection wherever tasks run, by as many tasks as run at once; a process that gets none stays as it is."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


#: What lean() empties: caches made by held().
_caches: list = []


def held(make: Callable) -> Callable:
    """As functools.cache, for what a worker process keeps between tasks of one step; see lean()."""
    out = functools.cache(make)
    _caches.append(out)
    return out


def release() -> None:
    """Give memory that this process has freed back to the system, which malloc and Arrow else keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable, cache: Callable | None = None) -> Callable:
    """run, which a Python worker calls, with release() at its end and, at its start, nothing held() but in `cache`.

    Workers outlive their tasks, beside the JVM and the workers of later steps.
    """

    def start() -> None:
        for c in _caches:
            if c is not cache:
                c.cache_clear()

    @functools.wraps(run)
    def each(*args):
        start()
        out = run(*args)
        release()
        return out

    @functools.wraps(run)
    def stream(frames):
        start()
        try:
            yield from run(frames)
        finally:
            release()

    return stream if inspect.isgeneratorfunction(run) else each


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors recompute nothing before it."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    tidy(df.sparkSession)
    return out


def keep(df: DataFrame) -> DataFrame:
    """As cut(), but as compressed columns, for tables that are large and read in part."""
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspan_path = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables made by keep(); nothing that is still to be computed may read them."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._loomspan_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Ids up to which a sieve is made, and its bits for each.
SIEVE_IDS = 1_000_000
SIEVE_BITS = 16


def sieve(ids: DataFrame, column: str) -> Column:
    """A condition on the long column `column` that all of ids meet and few others do, to thin out rows before a join.

    It is a constant of SIEVE_BITS bits an id, at most 2 MB; for more ids it
    lets everything pass, and the join alone decides.
    """
    n = ids.limit(SIEVE_IDS + 1).count()
    if n > SIEVE_IDS:
        return F.lit(True)
    bits = max(64, n * SIEVE_BITS // 64 * 64)
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits).cast("long")) for k in (1, 2)]
    words = ids.select(F.explode(F.array(*places(F.col(column)))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    found = {r["w"]: r["b"] for r in words.collect()}
    data = F.from_json(F.lit("[" + ",".join(str(found.get(i, 0)) for i in range(bits // 64)) + "]"), "array<bigint>")
    out = F.lit(True)
    for p in places(F.col(column)):
        out &= F.getbit(F.get(data, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
    return out


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def batches(frames: Iterable[pd.DataFrame], text: str = "text", most: int = BATCH_BYTES) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """(rows, their texts in UTF-8; null is empty), a few MB at a time; one text alone may be longer."""
    for frame in frames:
        texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in frame[text]]
        begin, size = 0, 0
        for i, t in enumerate(texts):
            if i > begin and size + len(t) > most:
                yield frame.iloc[begin:i], texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if texts[begin:]:
            yield frame.iloc[begin:], texts[begin:]


def signed(values):
    """numpy uint64 as the int64 that Spark's long holds."""
    return values.view("int64")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def spread(df: DataFrame, rows_each: int) -> int:
    """Partitions for about rows_each rows in each, 1 at least."""
    return max(1, -(-df.count() // rows_each))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
