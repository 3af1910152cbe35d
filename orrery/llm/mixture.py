"""Sources mixed to target weights by systematic sampling, in SQL functions only.

Each source has a target, the words that the mix should take from it, and so each of its documents
an expected number of copies: target over size. Along a source's documents the expected copies
are summed, from one random offset on; a document is emitted once for each whole number that
its stretch of the sum reaches. So copies are the expected number, rounded up or down, and any run
of documents has the expected total but for one. Documents lie in the order of their sizes:
large and small ones are taken alike, and a source's taken words stay within a document's size
of its target.

Sums are whole billionths, added exactly; they don't depend on the order of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.columns import bucket32
from orrery.llm.common import kept, told_apart
from orrery.operators.ranks import running_counts

#: Weights of the sources in their order, again and again.
WEIGHTS = (5, 2, 1)
#: Parts of a copy.
UNIT = 1_000_000_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """`sizes(source, source_size)`, a row per source -> with `place` (from 1, by code points, null
    last), `weight` and `target`: `share` of all sizes dealt by weight, but no source more than
    `most` times its size; what one leaves goes to the others by weight, until none is above.

    The targets are least(most * size, level * weight) at one level for all. Ordered by the level at
    which they stop, sources before a place are full and the others take by weight; the level is
    the greatest of those that the places would need. All sums over sources are dealt by ranges,
    so sources may be many."""
    order = F.struct(F.col("source").isNull().alias("last"), "source")
    listed = running_counts(sizes.select(F.lit(0).alias("all"), order.alias("at"), "source", "source_size", F.lit(1).cast("bigint").alias("one")), "all", "at", ["one"])
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.pmod(F.col("one_upto") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = listed.select("source", "source_size", F.col("one_upto").alias("place"), weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    full = F.struct((F.col("cap") / F.col("weight")).alias("level"), "place")
    placed = kept(placed.select(F.lit(0).alias("all"), full.alias("at"), "source", "source_size", "place", "weight", "cap"), "sources")
    summed = running_counts(placed, "all", "at", ["cap", "weight"])
    whole = placed.agg((F.sum("source_size") * F.lit(share)).alias("total"), F.sum("weight").alias("weights"))
    needed = (F.col("total") - (F.col("cap_upto") - F.col("cap"))) / (F.col("weights") - (F.col("weight_upto") - F.col("weight")))
    level = summed.crossJoin(F.broadcast(whole)).agg(F.greatest(F.lit(0.0), F.max(needed)).alias("level"))  # whole is one row
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return placed.crossJoin(F.broadcast(level)).select("source", "source_size", "place", "weight", target.alias("target"))  # so is level


def systematic(rows: DataFrame, by: str, order: list[str], expected: str, offset: str) -> DataFrame:
    """The rows with `copies`: how many whole numbers lie in each row's stretch of the running sum of
    `expected`, along `order` within `by`, from `offset` on; both in billionths. Rows are dealt by
    ranges of (by, order), so a group of any size is spread over tasks; rows that agree in all
    of these share their copies among them in any order."""
    summed = running_counts(rows.withColumns({"_at": F.struct(*order), "_exact": F.col(expected).cast("decimal(20,0)")}), by, "_at", ["_exact"])
    begin = F.pmod(F.col(offset) + F.col("_exact_upto") - F.col("_exact"), F.lit(UNIT)).cast("bigint")
    return summed.withColumn("copies", F.call_function("div", begin + F.col(expected), F.lit(UNIT).cast("bigint"))).drop("_at", "_exact", "_exact_upto")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 42) -> DataFrame:
    """`docs(doc_id, source, text, ...)` -> `(doc_id, source, size, source_size, target, copies)`, one
    row per input row: its words, its source's words and target, and how often the mix takes it
    (`most` times at most).

    A null text has no words; a null source is a source, the last one. A source without words has
    target 0 and no copies; so has an empty table, with no rows. Rows of a source with equal sizes
    lie in the order of doc_id, null first; rows that share a doc_id too in the order of a hash of
    their texts, and identical ones share their copies. The result depends on the rows alone, not
    on their order or partitions. Other columns aren't read.
    """
    sized = kept(with_sizes(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    return taken(sized, weights, share, most, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: each row of `docs`, with all its columns, as often as `mix` takes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = taken(with_sizes(docs.select(row, "doc_id", "source", "text")).drop("text"), weights, share, most, seed)
    return found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy")).select("row.*")


def with_sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return told_apart(docs)[0].withColumn("size", size)


def taken(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """`sized(doc_id, mark, source, size, ...)` with `source_size`, `target` and `copies`."""
    found = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    parts = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * F.lit(float(UNIT))).cast("bigint"), F.lit(0).cast("bigint"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    offset = F.call_function("div", bucket32(F.lit(str(seed)), name) * UNIT, F.lit(1 << 32))
    plan = kept(found.select(F.col("source").alias("_source"), "source_size", "place", "target", parts.alias("expected"), offset.alias("offset")), "plan")
    # A row per source: broadcast by Spark where it is small, else joined by the source, a hot one in pieces.
    rows = sized.join(plan, sized.source.eqNullSafe(plan["_source"])).drop("_source")
    return systematic(rows, "place", ["size", "doc_id", "mark"], "expected", "offset")
