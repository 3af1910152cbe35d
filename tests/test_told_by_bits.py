"""Rows are told by a table of bits before a join shuffles them; the join stays exact."""

from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.operators.retrieval import bm25_stages
from orrery.sources.shared import told_by_bits


def test_rows_are_told_where_they_are_read(spark):
    rows = spark.range(20_000).withColumn("text", F.lit("x")).unionByName(spark.sql("select cast(null as bigint) as id, 'y' as text"))
    wanted = spark.range(0, 20_000, 200)
    some, rest = told_by_bits(rows, wanted, ["id"])
    near, far = [[r.id for r in x.collect()] for x in (some, rest)]
    assert len(near) + len(far) == 20_001 and None in far
    assert {*range(0, 20_000, 200)} <= {*near} and len(near) < 110 and some.columns == ["id", "text"]


def test_documents_that_surely_stay_are_not_shuffled(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id").cast("string")) for i in range(30)]).alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 1000))
    out = simhash.drop_near_copies(docs)
    assert sorted(r.doc_id for r in out.collect()) == [*range(400)]
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_further_terms_make_no_rows(spark):
    units = spark.createDataFrame([(i, " ".join(["common", "often", f"own{i}", *(["rare"] if i % 7 == 0 else [])])) for i in range(300)], "doc_id long, text string")
    units = units.unionByName(units.where("doc_id = 7"))  # a repeated id adds up
    queries = spark.createDataFrame([(1, "rare common often own14")], "query_id int, text string")
    last = {r.unit: r.score for r in bm25_stages(queries, units, "doc_id", 3)[-1].collect()}
    best = sorted(last, key=lambda u: -last[u])
    assert best[:2] == [14, 7] and abs(last[7] - 2 * last[best[2]]) < 1e-9
