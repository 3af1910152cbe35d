"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources.shared import kept


#: Edges from which on a star's centre may be too large for one task.
MANY = 1_000_000


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`edges(a, b)` of a comparable type -> `(node, root)`, one row per node that has an edge;
    root is the least node that can be reached. Null ends are ignored; self loops and repeated
    edges do no harm; an empty table gives an empty table.

    Each round hooks every node's larger neighbours to its least neighbour, then its smaller
    ones (large star, small star). A star's centre is only ever a join key, never a collected
    group; from MANY edges on, the table of least neighbours is kept before it is joined, so both
    sides come from a shuffle of their own and Spark can split the centre of a large star. Rounds
    grow with the logarithm of the longest chain.
    """
    now = kept(edges.where("a is not null and b is not null and a <> b").distinct(), "edges")
    size, before = now.count(), None
    if not size:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        apart = (lambda df: kept(df, "stars")) if size >= MANY else (lambda df: df)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = apart(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = (
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        down = apart(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = apart(down.groupBy("a").agg(F.min("b").alias("m")))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = down.join(least, "a").select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = kept(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        size, before = state[0], state
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("b").agg(F.first("b").alias("root")).select(F.col("b").alias("node"), "root")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
