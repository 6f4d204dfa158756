"""Connected components of graphs held as edges, in groups, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import forget, kept
from .joining import merged

#: Rows of a round that are few enough for one exchange without splitting.
FEW = 100_000


def least_reachable(edges: DataFrame, by: list[str], most_rounds: int = 60) -> DataFrame:
    """(by, node, root): the least node that each node of ``edges`` (by, u, v) reaches within its group.

    Large stars and small stars in turn; every round is written, and the loop
    ends when a round changes nothing.  What a node's neighbours learn is one
    row a node, and merged with the edges, so that the driver holds none of it.  Beyond
    ``FEW`` rows (counted) it is written first: then AQE can split the exchange of a root that
    many nodes have.  Nodes without edges have no row.
    """
    pairs, before = kept(edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    rows = pairs.count()
    for _ in range(most_rounds):
        aside: list[DataFrame] = []

        def tell(edges: DataFrame, least: DataFrame) -> DataFrame:
            if 2 * rows <= FEW:  # noqa: B023
                return merged(edges, least, [*by, "u"])
            aside.append(kept(least, "least"))  # noqa: B023
            return merged(edges, aside[-1], [*by, "u"])  # noqa: B023

        both = pairs.unionByName(pairs.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = tell(both.where("v > u"), least).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = tell(large, least).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = kept(small.unionByName(least.select(*by, "u", F.col("m").alias("v"))).distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        for old in (pairs, *aside):
            forget(old)
        pairs, rows = new, now[0]
        if now == before:
            flat = pairs.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
            return flat.unionByName(pairs.select(*by, F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
