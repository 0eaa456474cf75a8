"""Writers: reports as CSV and GeoJSON, and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerlake.operators import merging


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, Windows line ends and a byte-order mark, as spreadsheets take it; in as many files as ``rows`` has partitions."""
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    marked.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quoteAll", True).csv(path)


def features(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``(value)``: a GeoJSON feature for each row that has coordinates."""
    props = F.to_json(F.struct(*[c for c in rows.columns if c not in (lon, lat)]))
    point = F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%s,%s]},"properties":', F.col(lon).cast("string"), F.col(lat).cast("string"))
    return rows.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.concat(point, props, F.lit("}")).alias("value"))


def write_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces only the partitions that ``rows`` has; an open month is written again, a closed one stays."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def archive(rows: DataFrame, path: str, uid: str, fetched: str) -> None:
    """Adds raw records to an archive, which keeps the newest of each uid; uids that aren't in ``rows`` stay."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        rows = spark.read.parquet(path).unionByName(rows, allowMissingColumns=True)
    merging.swap_in(merging.latest(rows, [uid], [fetched]), path)
