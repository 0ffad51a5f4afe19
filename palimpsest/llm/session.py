"""What the operators need of a Spark session: checkpoints in shared storage and bounded Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch; at Spark's default of 10,000 a run of long texts would not fit in a worker.
ARROW_ROWS = 512
#: Words of 64 bits in a prefilter; 2**17 of them are 1 MB, whatever the size of the input.
FILTER_WORDS = 1 << 17


def prepare(spark: SparkSession) -> None:
    """Set the checkpoint folder where none is set, and Arrow batches that fit in a worker's memory.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as it is. Only without it,
    as in tests with one JVM, a temporary folder is taken.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.master.startswith("local"):  # on a cluster the package is shipped with --py-files
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext.getCheckpointDir()
    if found is not None:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps don't repeat it when executors are lost.

    The table goes when discard() is told so, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/kept/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    passing(spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def passing(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the driver's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def discard(*tables: DataFrame) -> None:
    """Delete tables of keep() that nothing needs any more, and let Spark drop shuffle files that nothing refers to."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    tidy(tables[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to; else they stay until the driver happens to collect its garbage. Then trim()."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Have the driver's JVM give freed native memory back to the system, if it knows how (Java 17.0.9, or 18, on Linux); whether it did.

    Each join and each broadcast has threads of its own for a minute, and what they freed would stay in the allocator's pools, one for each few threads.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; other columns of the input can't clash with those an operator adds."""
    types = {"doc_id": "bigint", "vec_id": "bigint", "item_id": "bigint"}
    return df.select(*[F.col(f"`{old}`").cast(types[new]).alias(new) if new in types else F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(total: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` units hold ``total`` units."""
    return max(least, int(total // each) + 1)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0)).alias("n")).first()["n"]


def _maybe(df: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, Column, str]:
    """``df`` with a table of bits, whether a row's key may be among the single column of ``wanted``, and the table's name.

    The table has FILTER_WORDS words, whatever the size of ``wanted``: that bounds the broadcast.
    """
    key, name = wanted.columns[0], fresh(df, "bits_")
    bit = lambda c, seed: F.pmod(F.xxhash64(c.cast("bigint"), F.lit(seed)), F.lit(FILTER_WORDS * 64))
    slots = wanted.select(F.explode(F.array(*[bit(F.col(key), s) for s in (1, 2)])).alias("bit"))
    slots = slots.groupBy(F.expr("cast(bit div 64 as int)").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
    got = slots.toArrow()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[got.column("slot").to_numpy()] = got.column("word").to_numpy()
    filled = df.sparkSession.createDataFrame(pa.table({name: pa.array([words], pa.list_(pa.int64()))}))

    def hit(seed: int) -> Column:
        b = bit(F.col(f"`{column}`"), seed)
        return F.col(name)[(b / 64).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % 64).cast("int"))) != 0

    return df.crossJoin(F.broadcast(filled)), F.coalesce(hit(1) & hit(2) & F.col(f"`{column}`").isNotNull(), F.lit(False)), name


def prefilter(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``wanted``; no row of a wanted key is lost, and a join still has to follow.

    It spares the shuffle of texts that no join needs.
    """
    both, hit, bits = _maybe(df, column, wanted)
    return both.filter(hit).drop(bits)


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key isn't among the single column of ``gone``; only those that may be are shuffled. Null keys stay."""
    both, hit, bits = _maybe(df, column, gone)
    name = fresh(df, "gone_")
    gone = gone.select(F.col(gone.columns[0]).cast("bigint").alias(name))
    some = both.filter(hit).drop(bits)
    return both.filter(~hit).drop(bits).unionByName(some.join(gone, F.col(f"`{column}`").cast("bigint") == F.col(name), "left_anti"))


def one_each(df: DataFrame, column: str, repeated: DataFrame) -> DataFrame:
    """Of the rows with a key among the single column of ``repeated`` one for each key, by a hash of all columns; other rows as they are."""
    both, hit, bits = _maybe(df, column, repeated)
    name = fresh(df, "rank_")
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    rank = F.row_number().over(Window.partitionBy(F.col(f"`{column}`")).orderBy(F.xxhash64(*values)))
    some = both.filter(hit).drop(bits).withColumn(name, rank).filter(F.col(name) == 1).drop(name)
    return both.filter(~hit).drop(bits).unionByName(some)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
