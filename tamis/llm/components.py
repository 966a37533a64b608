"""Connected components of a link table by alternating large-star and small-star steps.

Each round is a few joins and partial aggregates; its result is written to the shared folder, so lineage stays
short and a lost executor costs one round. No node's neighbour list is ever gathered, so hubs are joins with a
skewed key, which adaptive execution splits. The driver sees two numbers a round.

Cases: null ends and self links are dropped, repeated links count once, no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.shared import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b. Large star ties greater neighbours to the least of the neighbourhood, small star the others."""
    sides = links.union(links.select("b", "a")) if large else links
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    tied = sides.join(least, sides["a"] == least["n"])
    if large:
        tied = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return tied.where("a > b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node with a link: component is the least node it can reach."""
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a > b").distinct()
    # Where nodes have links to many heads, a small star first leaves each node one, and links between heads.
    links = staged(_star(links, False), "links")
    seen = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        links = staged(_star(_star(links, True), False), "links")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
