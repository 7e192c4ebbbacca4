"""Small shared pieces: table reading, lineage cuts, gapless row numbers, sizes that are checked before a broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taleloom.session import checkpoint_folder, cut_lineage, ship_package

LOCAL_BITS = 33  # monotonically_increasing_id() keeps the position within a partition in its low 33 bits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(df: DataFrame) -> None:
    """Arrow batches of 8 MB at most in this session: texts are long, and the default of 64 MB is held by Spark and by each Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def written(df: DataFrame) -> DataFrame:
    """The rows of df from the shared checkpoint folder: read again, they are not computed again."""
    return cut_lineage(df)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows of df from a Parquet table in the shared checkpoint folder.

    For loops: a checkpoint hands on the size that was estimated for its plan, and joins multiply such estimates round after round; a table has
    the size of its files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tables/{uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that a result will define itself, whatever their case."""
    own = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in own))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with a gapless 0-based long by the given order.

    Rows are range-partitioned and sorted; each partition counts its own rows, and a table with one row per partition moves the counts on.
    The sorted rows are written first, so both uses see the same partitions. Equal rows get neighbouring numbers in any order.
    """
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_at", at))
    part, local = F.shiftright("_at", LOCAL_BITS), F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    before = (
        ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    )
    # one row per partition, so its size is bounded by the number of tasks
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + local).drop("_at", "_part", "_before")


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left", most_rows: int = 100_000) -> DataFrame:
    """Join a written side table on null-safe keys; it is broadcast if it has been counted and is small, else shuffled (AQE then splits skew)."""
    renamed = side.select(*(F.col(f"`{c}`").alias(f"_k_{c}" if c in keys else c) for c in side.columns))
    if side.limit(most_rows + 1).count() <= most_rows:
        renamed = F.broadcast(renamed)
    joined = df.join(renamed, _same(keys), how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*(f"_k_{k}" for k in keys))


def anti(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df less the rows whose keys the written side table has."""
    return attach(df, side, keys, "left_anti")


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`"))
    return on


def thinned(df: DataFrame, gone: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df less the rows whose keys the written table `gone` has; where its _stay holds, one of the rows with these keys comes back."""
    own = [F.col(f"`{c}`") for c in columns]
    main = anti(df, gone.select(*keys), keys).select(*own)
    repeated = gone.where("_stay")
    if repeated.isEmpty():
        return main
    again = attach(df, repeated.select(*keys), keys, "left_semi").select(*keys, F.struct(*own).alias("_whole"))
    return main.unionByName(again.groupBy(*keys).agg(F.any_value("_whole").alias("_whole")).select("_whole.*"))
