"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import scratch_root


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links (a, b)``: the least node reachable.

    Each round takes the least label of the neighbours and then the label of that label, so
    paths shorten by half; a round is a table in the shared scratch folder, which cuts the
    lineage.  Messages are minima, aggregated before they are shuffled, so a node with very many
    links is no hot spot.
    """
    spark = links.sparkSession
    root = scratch_root(spark, "components")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both.write.parquet(f"{root}/links")
    both = spark.read.parquet(f"{root}/links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels.write.parquet(f"{root}/0")
    step = 0
    while True:
        old = spark.read.parquet(f"{root}/{step}")
        heard = both.join(old.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = old.join(heard, "node").select("node", F.least("label", "heard").alias("label"))
        far = old.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = near.join(far, "label", "left").select("node", F.coalesce(F.least("label", "further"), F.col("label")).alias("label"))
        step += 1
        new.write.parquet(f"{root}/{step}")
        new = spark.read.parquet(f"{root}/{step}")
        if not new.join(old.withColumnRenamed("label", "was"), "node").filter("label <> was").limit(1).count():
            return new
