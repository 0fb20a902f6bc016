"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(app: str = "ravelin", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, adaptive execution, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or for local masters a temporary one.

    On a cluster without the setting this raises: a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="ravelin-ckpt-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably and forget its lineage; the shuffles it took leave the disk. The partitioning is kept.

    So is Spark's guess of its size, unless it is beyond what Spark takes for unknown sizes. A join's guess is the product of its sides', so in loops
    that join a table with itself its digits double each round and soon fill the driver.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    jvm, session_ = spark.sparkContext._jvm, spark._jsparkSession
    classic = jvm.org.apache.spark.sql.classic.Dataset
    swept = jvm.java.lang.Class.forName("org.apache.spark.sql.execution.RemoveShuffleFiles$", True, jvm.Thread.currentThread().getContextClassLoader()).getField("MODULE$").get(None)
    done = DataFrame(classic.ofRows(session_, df._jdf.queryExecution().analyzed(), swept), spark).checkpoint(eager=True)
    plan = done._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() <= session_.sessionState().conf().defaultSizeInBytes():
        return done
    none = jvm.scala.Option.apply(None)
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, session_, none, none)
    return DataFrame(classic.ofRows(session_, plain), spark)


def stored(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """df written as Parquet below the shared checkpoint folder and read again (columnar, prunable)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a stored() table."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0].split("/table-")[0] + "/table-" + f.split("/table-")[1].split("/")[0] for f in df.inputFiles() if "/table-" in f}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def latest(df: DataFrame, key: Sequence[str | Column], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest order struct (nulls lowest). Combines before the shuffle,
    so a key that holds a third of all rows costs one row per map task."""
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    best = df.groupBy(*cols).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r"))
    names = [c for c in best.columns if c != "_r"]
    return best.select(*names, *[F.col("_r")[c].alias(c) for c in keep if c not in names])


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum of value within group, in the given total order, without one task per group.

    Rows are range-partitioned by (group, order), so a group of any size is spread over tasks; sums of the
    (task, group) pieces are accumulated over the few pieces, then added to the sums inside each piece.
    """
    g = [F.col(c) for c in group]
    placed = cut(
        df.withColumn("_sort", F.struct(*order))
        .repartitionByRange(max(1, parts(df.sparkSession)), *g, F.col("_sort"))
        .withColumn("_piece", F.spark_partition_id())
    )
    pieces = placed.groupBy(*group, "_piece").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*group, "_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_piece").orderBy("_sort").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_inside", F.sum(value).over(inside))
    cond = [local[c].eqNullSafe(pieces[c]) for c in [*group, "_piece"]]
    joined = local.join(pieces, cond).select(*[local[c] for c in df.columns], (F.col("_inside") + F.col("_before")).alias(out))
    return joined


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
