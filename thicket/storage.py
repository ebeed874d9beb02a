"""Where intermediate results go, and how lineage is cut.

Everything that outlives a stage is kept in the folder that the cluster names
in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made for
a session whose executors are threads of the driver (tests), and any other
session is refused, as its executors would each write to their own disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: smaller on disk than a checkpoint, and columns can be pruned."""
    return Scratch().written(df, name)


class Scratch:
    """Written tables of one operator, which are removed once nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def clear(self, *tables: DataFrame) -> None:
        """Removes the given tables from the shared folder, or all."""
        for key in [id(t) for t in tables] or list(self.paths):
            back, path = self.paths.pop(key)
            there = back.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(back.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session's shuffles have, which Spark then leaves apart: groups of few bytes can be much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its rows numbered from 0 by columns that are unique together; no task sees more than one range of the rows.

    Ranges are written first, as ranges drawn again by a lost task may differ.
    """
    part = "\u0000part"
    ranges = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    counts = ranges.groupBy(part).agg(F.count("*").alias("\u0000n"))  # one row per range
    before = F.coalesce(F.sum("\u0000n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(part, before.alias("\u0000before"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranges.withColumn(name, own).join(F.broadcast(starts), part).withColumn(name, (F.col(name) + F.col("\u0000before")).cast("long")).drop(part, "\u0000before")


def small(df: DataFrame, most_rows: int, most_bytes: int = 64 << 20) -> DataFrame:
    """df, which must be cheap to read twice, marked for broadcast if it has at most most_rows rows and its columns of varying length at most most_bytes; else left for a shuffled join."""
    sized = [F.col(f"`{c}`") if kind in ("string", "binary") else F.to_json(F.struct(F.col(f"`{c}`"))) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in sized]
    held = df.limit(most_rows + 1).agg(F.count("*").alias("n"), sum(sizes, F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if held["n"] <= most_rows and held["bytes"] <= most_bytes else df
