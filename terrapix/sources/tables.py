"""Readers, writers and file-level operators of point and grid tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = {"latitude": "lat", "lat_deg": "lat", "longitude": "lon", "lon_deg": "lon"}
POINT_COLUMNS = ("unique_id", "lat", "lon", "time", "p_area", "capacity_m", "country")
SCENARIO_ALIASES = ("rcp", "rcp_scenario", "rcp_category")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; a temporary one where a local session names none (a cluster raises)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    conf = conf or (current.get() if current.isDefined() else None)
    if not conf and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    top = f"{(conf or tempfile.mkdtemp(prefix='terrapix-')).rstrip('/')}/grid-{uuid.uuid4().hex}"
    _made.append(top)
    return f"{top}/{name}"


_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate files that this driver made; results that read them must be stored by then."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def rename_coordinates(df: DataFrame) -> DataFrame:
    """Lower-case coordinate names and their aliases to lat and lon."""
    names = {c: ALIASES.get(c.lower(), c.lower()) for c in df.columns if c.lower() in {*ALIASES, "lat", "lon"}}
    return df.withColumnsRenamed(names)


def read_points(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """Points from CSV with a header: coordinate aliases, required columns, doubles (a bad number raises), a date for the year."""
    df = require(rename_coordinates(spark.read.option("header", True).csv(path)), POINT_COLUMNS)
    doubles = {c: F.col(c).cast("double") for c in ("lat", "lon", "p_area", "capacity_m")}
    df = df.withColumns({**doubles, "year": F.substring("time", 1, 4).cast("int")})
    df = df.withColumn("time", F.make_date("year", F.lit(1), F.lit(1)))
    return df if years is None else df.where(F.col("year").isin(*years))


def union_year_files(frames: dict[int, DataFrame], keys: list[str]) -> DataFrame:
    """Tables of several years with the year as a column; of rows with equal keys and year one stays."""
    parts = [df.drop("year").withColumn("year", F.lit(y)) for y, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).dropDuplicates([*keys, "year"])


def load_active_cells(df: DataFrame, year: int, keys: list[str], start: str = "start_year", duration: str = "duration") -> DataFrame:
    """Rows with keys whose spell lasts to ``year``, flagged, without the duration."""
    return df.dropna(subset=keys).where(F.col(start) + F.col(duration) - 1 >= year).withColumn("current_abandonment", F.lit(1)).drop(duration)


def load_embedding(df: DataFrame, years: list[int], keys: list[str], drop: list[str]) -> DataFrame:
    return df.where(F.col("year").isin(*years)).dropna(subset=keys).drop(*drop)


def grid_wide(dynamic: dict[str, DataFrame], static: dict[str, DataFrame], keys: list[str], time: str) -> DataFrame:
    """One table of many one-variable grids; static ones are joined to every time without being repeated."""
    out = reduce(lambda a, b: a.join(b, [*keys, time]), [df.select(*keys, time, F.col("value").alias(n)) for n, df in dynamic.items()])
    return reduce(lambda a, b: a.join(b, keys, "left"), [df.select(*keys, F.col("value").alias(n)) for n, df in static.items()], out)


def tile(df: DataFrame, size: int = 500, width: int = 1000) -> DataFrame:
    """``df`` with the number of its ``size`` x ``size`` tile."""
    return df.withColumn("tile_id", (F.floor(F.col("lat_idx") / size) * width + F.floor(F.col("lon_idx") / size)).cast("long"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def finished_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tiles (tile_id) whose writing under ``path`` ended well: its list, not its folders, says so."""
    done = f"{path.rstrip('/')}/_finished"
    rows = spark.read.schema("tile_id long").parquet(done) if _exists(spark, done) else spark.createDataFrame([], "tile_id long")
    return rows.distinct()


def write_tiles(df: DataFrame, path: str, skip_written: bool = True) -> None:
    """Tiles as partitions; tiles on the list of finished ones are not computed again.

    A tile's partition is replaced as a whole, and only after the write a tile is put on the list. So a job that failed
    half-way is simply run again: what it left counts for nothing and no row is doubled or lost. Readers do not see
    the list, whose name begins with an underscore.
    """
    spark = df.sparkSession
    tiles = df.select(F.col("tile_id").cast("long").alias("tile_id")).where("tile_id is not null").distinct()
    if skip_written:
        tiles = tiles.join(finished_tiles(spark, path), "tile_id", "left_anti")
    tiles = stored(tiles, "tiles")
    if tiles.isEmpty():
        return
    rows = df.join(tiles, "tile_id", "left_semi").repartition("tile_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_id").parquet(path)
    tiles.write.mode("append").parquet(f"{path.rstrip('/')}/_finished")


def bbox_extract(spark: SparkSession, path: str, tiles: list[int], lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Rows in a box from a tiled table: other tiles are pruned, the box is pushed down."""
    return spark.read.parquet(path).where(F.col("tile_id").isin(*tiles) & F.col("lat").between(*lat) & F.col("lon").between(*lon))


def write_fact(df: DataFrame, path: str, by: str = "analysis_year", fmt: str = "parquet", batch: str | None = None) -> None:
    """Facts in partitions ``by`` a column. With ``batch`` each partition has one folder a batch, which the batch replaces
    when it is run again, so that batches add up and none counts twice; without it, the touched partitions are replaced."""
    rows, parts = (df, [by]) if batch is None else (df.withColumn("batch", F.lit(batch)), [by, "batch"])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).format(fmt).option("header", True).save(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("time", "lat", "lon", "p").write.mode("overwrite").parquet(path)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names; one name for the pathway column, made from the category where there is none."""
    df = df.toDF(*[c.lower() for c in df.columns])
    have = [c for c in SCENARIO_ALIASES if c in df.columns]
    if have:
        return df.withColumn("rcp_category", F.coalesce(*have)).drop(*[c for c in have if c != "rcp_category"])
    from ..operators.scalar import rcp_of_category

    return df.withColumn("rcp_category", rcp_of_category(F.col("category"))) if "category" in df.columns else df


def read_gzip_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gzip CSV with a header; each file is one partition until it is repartitioned."""
    return spark.read.schema(schema).option("header", True).csv(path)


def collect_runs(spark: SparkSession, path: str, ids: DataFrame, schema: str) -> DataFrame:
    """One row per expected run; runs without a file have null metrics."""
    return ids.join(spark.read.schema(schema).json(path), "exp_id", "left")


def yearly_mean(frames: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Cellwise mean of equally shaped grids; a cell that any of them lacks is null."""
    n = len(frames)
    rows = reduce(lambda a, b: a.unionByName(b), [f.select(*keys, value) for f in frames])
    return rows.groupBy(*keys).agg(F.when(F.count(value) == n, F.sum(value) / n).alias(value))


def monthly_then_annual_mean(df: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """Mean of monthly means of daily values."""
    monthly = df.groupBy(*keys, F.month(day).alias("month_")).agg(F.avg(value).alias(value))
    return monthly.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("months"))


def add_grids(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cellwise sum; grids must have the same cells."""
    other = b.select(*keys, F.col(value).alias("other_"))
    return a.join(other, keys).select(*keys, (F.col(value) + F.col("other_")).alias(value))


def time_and_name(df: DataFrame, value: str, feature: str, year: int | None) -> DataFrame:
    out = df.withColumnRenamed(value, feature)
    return out if year is None else out.withColumn("time", F.make_date(F.lit(year), F.lit(1), F.lit(1)))
