"""Raster and vector scans and sinks, and grids derived from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 100


def no_data(value: Column, marker: float = -9999.0) -> Column:
    """NULL for values near the marker, below -1e30, or NaN."""
    near = F.abs(value - F.lit(marker)) <= F.lit(1e-8) + F.lit(1e-5) * abs(marker)
    return F.when(near | (value < F.lit(-1e30)) | F.isnan(value), F.lit(None)).otherwise(value)


def read_raster(spark: SparkSession, path: str, marker: float = -9999.0) -> DataFrame:
    """A raster stored as cells (r, c, z); NoData becomes NULL."""
    df = spark.read.parquet(path)
    return df.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), no_data(F.col("z").cast("double"), marker).alias("z"))


def write_raster(cells: DataFrame, path: str, value: str = "z", marker: float = -9999.0, tile: int = 1024) -> None:
    """Cells as float32 with the marker for NULL, partitioned by bands of tile rows."""
    out = cells.select("r", "c", F.coalesce(F.col(value), F.lit(marker)).cast("float").alias("z"), F.floor(F.col("r") / tile).alias("band"))
    out.write.mode("overwrite").partitionBy("band").option("compression", "zstd").parquet(path)


def band_statistics(cells: DataFrame, value: str = "z") -> DataFrame:
    v = F.col(value)
    return cells.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("valid"))


def event_grid(spark: SparkSession, sf_dir: str, value: Column | None = None, name: str = "z") -> DataFrame:
    """A dense grid WIDTH cells wide, one cell per event in order of event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    r, c = F.expr(f"cast(event_id div {WIDTH} as int)"), F.expr(f"cast(event_id % {WIDTH} as int)")
    z = F.lit(0.5) * r + F.lit(2.0) * c + F.col("value") * F.lit(0.125)
    return e.select(r.alias("r"), c.alias("c"), (value if value is not None else F.when(F.col("event_id") % 89 == 7, F.lit(None)).otherwise(z)).alias(name))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_grid(spark, sf_dir)


def dem_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_grid(spark, sf_dir, F.expr(f"0.5D * (event_id div {WIDTH}) + 2.0D * (event_id % {WIDTH}) + value * 0.125D"))


def dem_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation in steps of four units: ties and flats."""
    return dem(spark, sf_dir).withColumn("z", F.floor(F.col("z") / 4).cast("double"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_grid(spark, sf_dir, F.when(F.col("event_type") == "purchase", F.lit(2.0)).otherwise(F.lit(1.0)), "w")


def click_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_grid(spark, sf_dir, F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0), "stream")


def pour_points(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").cast("long").alias("pid"), (F.col("s_suppkey") * 37 % 100 + F.lit(0.5)).cast("double").alias("x"), (-(F.col("s_suppkey") * 53 % rows + F.lit(0.5))).cast("double").alias("y"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polyline an order: id, pts in order of line number."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"))
    pts = F.transform(F.sort_array(F.collect_list(key)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return li.groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(pts.alias("pts"))


def points_of_raster(cells: DataFrame, value: str = "z") -> DataFrame:
    """Valid non-zero cells as points, numbered row by row in two steps: rows are counted,
    then cells are numbered inside their row."""
    some = cells.filter(F.col(value).isNotNull() & (F.col(value) != 0))
    per_row = some.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    before = per_row.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("r").orderBy("c"))
    return some.withColumn("k", rank).join(before, "r").select((F.col("first") + F.col("k")).cast("long").alias("id"), (F.col("c") + F.lit(0.5)).alias("x"), (-(F.col("r") + F.lit(0.5))).alias("y"), value)


def cell_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Cell of a world point on a unit grid whose origin is (0, 0); truncates toward zero."""
    return (-y).cast("int"), x.cast("int")


def rasterise(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Grid of point ids, the largest pid of a cell wins, 0 elsewhere."""
    r, c = cell_of(F.col("x"), F.col("y"))
    at = points.select(r.alias("r"), c.alias("c"), "pid").groupBy("r", "c").agg(F.max("pid").alias("pid"))
    return cells.select("r", "c").join(at, ["r", "c"], "left").select("r", "c", F.coalesce("pid", F.lit(0)).cast("long").alias("seed"))


def single_points(points: DataFrame) -> DataFrame:
    """One row for each point of a multipoint (column pts), ids as given."""
    return points.select(*[c for c in points.columns if c != "pts"], F.explode("pts").alias("_p")).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")


def write_points(points: DataFrame, path: str) -> None:
    """Points as WKT with all their attributes."""
    text = F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    points.withColumn("wkt", text).write.mode("overwrite").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (id, order, length) as WKT."""
    lines_to_wkt(lines).select("id", "order", "length", "wkt").write.mode("overwrite").parquet(path)


def lines_to_wkt(lines: DataFrame) -> DataFrame:
    text = F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", F.transform("pts", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))), F.lit(")"))
    return lines.withColumn("wkt", text)
