"""Connected components of a table of links, by alternating stars.

Each step hangs every document's neighbours below the smallest of them. Steps are aggregations and
joins over links; each is written to the shared folder, which also cuts the lineage. Nothing is
gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def components(links: DataFrame, folder: str) -> DataFrame:
    """(u, v): for every linked document but the smallest of its component, the smallest. `links` has ids u and v."""
    spark = links.sparkSession
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, step = None, 0
    while True:
        path = f"{folder}/{step}"
        edges.write.parquet(path)
        edges = spark.read.parquet(path)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges
        before, step = now, step + 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = edges.select("e.*").filter("u <> v").distinct()
