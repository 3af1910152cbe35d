"""Views that several queries start from, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import products
from orrery.sources.tables import table

OFFER = """
offer as (
  select l_partkey as product_id, l_suppkey as retailer_id, l_orderkey, l_linenumber, l_shipdate as observed_at,
         (cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint)))
           // cast(l_quantity as bigint) as unit_price_e4
  from lineitem)"""

PREF = """
pref as (
  select c_custkey as pref_id,
         concat('looking for a ', p_name, ' by ', p_brand, ' under ', cast(cast(floor(p_retailprice * 3) as bigint) as varchar)) as text
  from customer join part on p_partkey = c_custkey)"""

SLOTS = """
slots as (
  select pref_id, text, nullif(regexp_extract(text, 'for an? (.+?) by ', 1), '') as name,
         nullif(regexp_extract(text, '(Brand#[0-9]+)', 1), '') as brand,
         try_cast(nullif(regexp_extract(text, 'under ([0-9]+)', 1), '') as bigint) * 10000 as max_price_e4
  from pref)"""

RESPONSE = """
response as (
  select event_id, user_id, cast(json_extract_string(props, '$.k') as int) as item_id, ts,
         case when value >= 35 then 1 else 0 end as correct
  from events)"""

LOWEST = """
lowest as (select product_id, retailer_id, min(unit_price_e4) as price_e4 from offer group by all)"""


def sql(*parts: str) -> str:
    """Named views and a final query as one statement."""
    return "with " + ",".join(parts[:-1]) + "\n" + parts[-1] if len(parts) > 1 else parts[0]


def offer(spark: SparkSession, sf: str) -> DataFrame:
    return products.offers(table(spark, sf, "lineitem"))


def pref(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    customer = table(spark, sf, "customer")
    cap = F.floor(F.col("p_retailprice") * 3).cast("bigint").cast("string")
    text = F.concat(F.lit("looking for a "), "p_name", F.lit(" by "), "p_brand", F.lit(" under "), cap)
    return customer.join(part, customer.c_custkey == part.p_partkey).select(F.col("c_custkey").alias("pref_id"), text.alias("text"))


def response(spark: SparkSession, sf: str) -> DataFrame:
    """Events as assessment answers: the item is a number in the properties."""
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("item_id"), "ts", F.when(F.col("value") >= 35, 1).otherwise(0).alias("correct")
    )
