"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _summary(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node id reachable, for every node of links (a long, b long).

    Alternates large-star and small-star steps until nothing changes, about log n times. Each step is a min by key
    (pre-aggregated map-side) and a join; a node with very many links is split by the skew join. Self links and
    repeated links are allowed.
    """
    now = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = _summary(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("node")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        joined = large.join(down, F.col("a") == F.col("node"))
        small = joined.filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(down.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
        now, last = materialise(small, "links"), now
        discard(last)
        after = _summary(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
