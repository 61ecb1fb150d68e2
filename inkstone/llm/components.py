"""Connected components of links between long ids, as joins and aggregations.

Labels go down to the smallest id in reach: each round takes the least label among the neighbours and
then follows labels of labels, so long chains need few rounds. Every round is written, once, so lineage stays
short, and both sides of each join are exchanges whose skewed keys can be split; what moved is counted as it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import counted, drop, keep, rows


def components(links: DataFrame) -> DataFrame:
    """id, root for every id in links (a, b); root is the smallest id reachable. No links give no rows."""
    both = keep(counted(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()), "links")
    most = rows(both)
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels", most)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = labels.join(near, "id").select("id", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        up = labels.select(F.col("id").alias("of"), F.col("root").alias("above"))
        down = low.join(up, low.low == up.of, "left").select("id", F.least("low", F.coalesce("above", "low")).alias("root"), "old")
        lower = keep(counted(down, F.col("root") < F.col("old")), "labels", most)
        drop(labels)
        labels = lower
        if not rows(lower):
            drop(both)
            return labels.select("id", "root")
