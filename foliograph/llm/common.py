"""Helpers shared by the operators of this subpackage: the shared folder, materialised steps and gapless ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset (tests in local mode) a temporary
    folder is made and set; a cluster without the setting uses the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if context.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="foliograph-")
    else:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_foliograph"
    context.setCheckpointDir(base)
    return context.getCheckpointDir().rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def drop_tables(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize that nothing reads any more."""
    for table in tables:
        if folder := getattr(table, "folder", None):
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def smallest(rows: DataFrame, hashed: Column, most: int, count: int, *ties: str) -> DataFrame:
    """At most `most` of the `count` rows, those of smallest hash (a signed 64-bit number).

    Rows whose hash is over twice the `most`-th smallest to be expected are left off first; else every task would send
    `most` rows to the one that takes the smallest. Where few distinct hashes repeat very often fewer rows may come.
    """
    if count > 4 * most:
        rows = rows.where(hashed <= 2 * most * (1 << 64) // count - (1 << 63))
    return rows.orderBy(hashed, *ties).limit(most)


def spread(*keys: Column | str) -> Column:
    """An even 48-bit number of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 16)


def gapless_rank(df: DataFrame, group: list[str], order: str, rows: int, cell_rows: int = 4096) -> DataFrame:
    """Adds `rank`: 0, 1, 2, ... in each group by `order`, an even 48-bit number (see spread).

    No group is sorted in one task: a group is cut by ranges of `order` into cells of about cell_rows rows
    even if it holds every row; cells are ranked in themselves and shifted by the counts of the cells before.
    df is read twice, so materialise it first if it is dear.
    """
    cells = max(1, -(-rows // cell_rows))
    celled = df.withColumn("_cell", F.expr(f"CAST(CAST({order} AS DECIMAL(20,0)) * {cells} / {1 << 48} AS BIGINT)") if cells > 32768 else F.shiftrightunsigned(F.col(order) * F.lit(cells), 48))
    counts = celled.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    before = W.Window.partitionBy(*group).orderBy("_cell").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.Window.partitionBy(*group, "_cell").orderBy(order)
    ranked = celled.withColumn("_r", F.row_number().over(inside) - 1)
    same = [ranked[c].eqNullSafe(starts[c]) for c in [*group, "_cell"]]
    joined = ranked.join(starts, on=_all(same), how="inner")
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_start") + F.col("_r")).alias("rank"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
