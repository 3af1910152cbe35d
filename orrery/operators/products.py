"""Product discovery: slots, search, extraction, duplicates, golden records, offers and ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.functions.columns import norm_text, run_rows, set_marks, unit_price_e4
from orrery.operators.graph import connected_components
from orrery.sources.shared import kept, spread, told_by_bits


def offers(lineitem: DataFrame) -> DataFrame:
    """Order lines as offers: the supplier is the retailer, the part the product."""
    return lineitem.select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("retailer_id"), "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("observed_at"), unit_price_e4(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity")).alias("unit_price_e4"),
    )


def extract_slots(df: DataFrame, text_col: str) -> DataFrame:
    """Name, brand and highest price (1e-4 units) of a preference; null where not said."""
    found = lambda pattern: F.nullif(F.regexp_extract(text_col, pattern, 1), F.lit(""))
    price = found(r"under ([0-9]+)").try_cast("bigint")
    return df.withColumns({"name": found(r"for an? (.+?) by "), "brand": found(r"(Brand#[0-9]+)"), "max_price_e4": F.when(price < 900_000_000_000_000, price * 10_000)})


def by_asks(prefs: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preferences and products by what is asked for: each name and brand that some preference has, null
    where it has none, is an `ask`, which is `free` where it has neither. The preferences with their ask,
    and `(ask, free, product_id)` for each row of `products` that fits it: at most four a row, since a slot
    is the product's own or not set."""
    asks = prefs.select(F.col("name").alias("_name"), F.col("brand").alias("_brand")).distinct()
    asks = kept(asks.select("*", F.monotonically_increasing_id().alias("ask"), (F.col("_name").isNull() & F.col("_brand").isNull()).alias("free")), "asks")
    here = F.col("name").eqNullSafe(F.col("_name")) & F.col("brand").eqNullSafe(F.col("_brand"))
    slots = [F.struct(n.alias("name"), b.alias("brand")) for n in (F.col("name"), F.lit(None)) for b in (F.col("brand"), F.lit(None))]
    fits = products.select("product_id", F.explode(F.array_distinct(F.array(*slots))).alias("s")).select("product_id", "s.*")
    return prefs.join(asks, here).drop("_name", "_brand"), fits.join(asks, here).select("ask", "free", "product_id")


def search(prefs: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Every preference's offers. A slot that isn't set matches everything. Offers get the asks that
    they fit (see by_asks) by their product and meet the preferences there, so no table with a row per
    preference and product is shuffled. Preferences with neither name nor brand, which ask for all, meet
    offers by bands of the price (powers of two), from the lowest up to the band of their own limit."""
    asking, fits = by_asks(prefs.select("pref_id", "name", "brand", "max_price_e4"), products)
    band = lambda c: F.when(F.col(c) >= 1, F.length(F.bin(c))).otherwise(0)  # noqa: E731  binary digits of a price
    bands = F.sequence(F.lit(0), F.when(F.col("max_price_e4").isNull(), 63).otherwise(band("max_price_e4")))
    asking = asking.select("ask", "pref_id", "max_price_e4", F.explode(F.when(F.col("free"), bands).otherwise(F.array(F.lit(-1)))).alias("band"))
    offered = offers.join(fits, "product_id").withColumn("band", F.when(F.col("free"), band("unit_price_e4")).otherwise(-1))
    hits = offered.join(asking, ["ask", "band"]).where("max_price_e4 is null or unit_price_e4 <= max_price_e4")
    return hits.select("product_id", "pref_id", *[c for c in offers.columns if c != "product_id"])


def alike(prefs: DataFrame, slots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Preferences with equal slots (null equals null) are one class, known by its least id: the rows of
    these alone, and `(pref_id, class_id)` of all. An id that has several rows has them all in its class."""
    marks = prefs.groupBy("pref_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*slots)))).alias("mark"))
    classes = kept(marks.groupBy("mark").agg(F.min("pref_id").alias("class_id")), "classes")
    members = kept(marks.join(classes, "mark").select("pref_id", "class_id"), "members")
    return prefs.join(classes.select(F.col("class_id").alias("pref_id")), "pref_id", "left_semi"), members


def search_classes(prefs: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """P2 by classes of preferences (see alike): the offers of each class, under its least `pref_id`, which
    is its `class_id`; and a row without an offer for each other preference, with its class."""
    first, members = alike(prefs, ["name", "brand", "max_price_e4"])
    hits = search(first, products, offers).withColumn("class_id", F.col("pref_id"))
    return hits.unionByName(members.where("pref_id <> class_id"), allowMissingColumns=True)


def union_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables with different columns as one, missing ones null, with their `source`."""
    named = [df.withColumn("source", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def enrich_offers(offers: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Product, retailer and nation attributes."""
    products = part.select(F.col("p_partkey").alias("product_id"), "p_name", "p_brand", "p_type")
    retailers = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("retailer_id"), "s_name", "n_name")
    return offers.join(products, "product_id").join(retailers, "retailer_id")


def extract_page(df: DataFrame) -> DataFrame:
    """P5: title, first heading, link targets and text of each page."""
    clean = F.regexp_replace("html", r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(clean, r"<[^>]*>", " "), r"\s+", " "))
    first = lambda pattern: F.nullif(F.regexp_extract(clean, pattern, 1), F.lit(""))
    return df.select(
        "page_id", first(r"(?s)<title>(.*?)</title>").alias("title"), first(r"(?s)<h1>(.*?)</h1>").alias("h1"),
        F.regexp_extract_all(clean, F.lit(r'href="([^"]*)"'), 1).alias("links"), text.alias("body"),
    )


def extract_json(df: DataFrame, col: str, schema: StructType | str) -> DataFrame:
    """The attributes of a JSON text as columns; null where it doesn't parse."""
    return df.withColumn("_json", F.from_json(col, schema)).select(*df.columns, "_json.*")


def dedup_exact(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """P10: the first row of each key by `order`, with the size of its group; rows that agree in
    `order` are told apart by their other columns, in turn, and rows that agree in all are one. One
    aggregation, with partial results before the shuffle: a hot key's rows never meet."""
    rest = [c for c in df.columns if c not in order and df.schema[c].dataType.typeName() not in ("map", "variant")]
    first = F.min_by(F.struct(*df.columns), F.struct(*order, *rest))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("_row"), F.count("*").alias("group_size")).select("_row.*", "group_size")


def run_jaccard(pairs: DataFrame, n: int) -> DataFrame:
    """`pairs(a, b, ta, tb)` of texts whose words stand between single spaces -> `(a, b, jaccard)` of their
    sets of runs of n words, compared word by word."""

    def runs(text: str) -> set[tuple[str, ...]]:
        words = [w for w in text.split(" ") if w]
        return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = runs(a.as_py()), runs(b.as_py())
                both = len(x & y)
                out.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, jaccard double")


def near_dup_pairs(df: DataFrame, id_col: str, text_col: str, n: int = 5, t: float = 0.8, bits: int = 64) -> DataFrame:
    """Links `(a, b, jaccard)` between documents whose sets of word runs agree to `t` or more.
    Documents with equal sets are one group, linked to its least id; only groups' representatives
    are compared, so copies never make all pairs.

    Runs are ordered by how many representatives have them. Two sets that agree to `t` share one
    of the first size - ceil(t * size) + 1 runs of either, and the more of them the nearer their
    sizes are, since few others can lie before the shared ones. Runs that one set alone has lead
    to nobody and aren't joined. Pairs that sizes, that number, or the places of the first and last
    shared run rule out are left out; the others are compared word by word. A run is known by two
    hashes, of `bits` and of 64 bits."""
    docs = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    docs = kept(docs.select("id", norm_text(F.col("text")).alias("text")), "normal")  # four steps read it
    marked = kept(set_marks(docs, "id", F.col("text"), n), "sets")
    groups = kept(marked.groupBy("mark").agg(F.min("id").alias("a")), "groups")
    copies = marked.select("id", "mark").join(groups, "mark").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    some, rest = told_by_bits(docs.where("id is not null"), copies.select(F.col("b").alias("id")), ["id"])  # the texts of all others aren't shuffled
    reps = some.join(groups.select(F.col("a").alias("id")).distinct(), "id").unionByName(rest)
    name = ["run", "checked"]
    # Rows are shuffled by their run once, and counted there; a run's rows go to disk where they are many.
    common = run_rows(reps, "id", F.col("text"), n, bits).withColumn("n", F.count("*").over(W.partitionBy(*name))).where("n > 1")
    listed = F.array_sort(F.collect_list(F.struct("n", *name)))  # no more than the document's own runs
    own = common.groupBy("id", "size").agg(listed.alias("x"))
    # Runs of this set alone would come first; so many of the prefix are taken by them.
    alone = F.col("size") - F.size("x")
    prefix = F.slice("x", F.lit(1), F.greatest(F.lit(0), F.least(F.size("x"), (F.col("size") - F.ceil(F.col("size") * t - 1e-6) + 1 - alone).cast("int"))))
    keys = kept(own.select("id", "size", alone.alias("alone"), F.posexplode(prefix).alias("at", "y")).select("id", "size", (F.col("alone") + F.col("at")).alias("pos"), "y.run", "y.checked"), "prefixes")
    left, right = (keys.select(F.col("id").alias(c), F.col("size").alias(f"n{c}"), F.col("pos").alias(f"p{c}"), *name) for c in "ab")
    whole = lambda v: F.ceil(v - 1e-6)
    needed = whole((F.col("na") + F.col("nb")) * (t / (1 + t)))
    met = left.join(right, name).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * t - 1e-6))
    ends = [f(f"p{c}").alias(f"{k}{c}") for c in "ab" for k, f in (("least", F.min), ("most", F.max))]
    near = F.col("n") >= needed - F.greatest(whole(F.col("na") * t), whole(F.col("nb") * t)) + 1
    for c in "ab":
        near = near & (F.col(f"least{c}") <= F.col(f"n{c}") - needed) & (F.col(f"most{c}") - F.col("n") + 1 <= F.col(f"n{c}") - needed)
    pairs = kept(met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"), *ends).where(near).select("a", "b"), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = kept(told_by_bits(docs, ids, ["id"])[0].join(ids, "id").dropDuplicates(["id"]), "texts")
    sized = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return run_jaccard(sized, n).where(F.col("jaccard") >= t).unionByName(copies)


def segments(length: Column, k: int) -> Column:
    """Places (from 1) and lengths of the k + 1 parts, as even as can be, of a text of `length`."""
    short = F.floor(length / (k + 1)).cast("int")
    longer = length - short * (k + 1)  # so many parts, the last ones, are one longer
    begin = lambda i: F.lit(1) + i * short + F.greatest(F.lit(0), i - (F.lit(k + 1) - longer))
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("part"), begin(i).alias("at"), (begin(i + 1) - begin(i)).alias("n")))


def near_texts(a: DataFrame, b: DataFrame, block: str, k: int) -> DataFrame:
    """`a(block, ta)`, `b(block, tb)` of distinct texts -> `(block, ta, tb, edits)` at most `k` edits
    apart. Of a text cut into k + 1 parts, k edits leave one part whole, at most k places away. So
    texts meet by (block, length, part, letters), not all of a block; then edits are counted."""
    size = F.char_length("tb")
    cut = b.select(block, "tb", size.alias("length"), F.explode(segments(size, k)).alias("s")).select(block, "tb", "length", "s.part", F.expr("substring(tb, s.at, s.n)").alias("letters"))
    own = F.char_length("ta")
    spans = a.select(block, "ta", F.explode(F.sequence(F.greatest(F.lit(0), own - k), own + k)).alias("length"))
    spans = spans.select(block, "ta", "length", F.explode(segments(F.col("length"), k)).alias("s"))
    last = F.char_length("ta") - F.col("s.n") + 1
    first = F.greatest(F.lit(1), F.col("s.at") - k)
    places = F.when(first <= F.least(last, F.col("s.at") + k), F.sequence(first, F.least(last, F.col("s.at") + k)))
    asked = spans.select(block, "ta", "length", "s.part", "s.n", F.explode(places).alias("at")).select(block, "ta", "length", "part", F.expr("substring(ta, at, n)").alias("letters")).distinct()
    pairs = asked.join(cut, [block, "length", "part", "letters"]).select(block, "ta", "tb").distinct()
    return pairs.withColumn("edits", F.levenshtein("ta", "tb", k)).where("edits >= 0")


def fuzzy_match(a: DataFrame, b: DataFrame, block: str, col: str, k: int) -> DataFrame:
    """Rows of the same block whose texts are at most `k` edits apart: `(a_id, b_id, edits)`.
    The edits of two distinct texts are found once, however many rows have them."""
    texts = lambda df, name: df.select(block, F.col(col).alias(name)).where(F.col(name).isNotNull()).distinct()
    near = near_texts(texts(a, "ta"), texts(b, "tb"), block, k)
    left, right = a.select(F.col("id").alias("a_id"), block, F.col(col).alias("ta")), b.select(F.col("id").alias("b_id"), block, F.col(col).alias("tb"))
    return near.join(left, [block, "ta"]).join(right, [block, "tb"]).select("a_id", "b_id", "edits")


#: Rows of a text, at most about, of which one task makes the pairs with as many of another.
SIDE = 4096


def fuzzy_pairs(df: DataFrame, block: str, col: str, k: int) -> DataFrame:
    """P12 of a table with itself: each pair once, `a_id` the lesser. Rows of equal block and text are a
    class, in pieces of about `SIDE` rows; near classes' pieces meet in squares, which are dealt to all
    tasks. What is shuffled grows with the rows and the texts near each, the pairs themselves never are,
    and a hot text is many squares."""
    rows = df.select("id", F.col(block).alias("block"), F.col(col).alias("text")).where("block is not null and text is not null")
    classes = rows.groupBy("block", "text").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("pieces"))
    classes = kept(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    texts = classes.select("block", F.col("text").alias("ta"))
    near = near_texts(texts, texts.withColumnRenamed("ta", "tb"), "block", k).where("ta <= tb")
    for c in "ab":
        pieces = F.sequence(F.lit(0), F.col("pieces") - 1)
        near = near.join(classes.withColumnRenamed("text", f"t{c}"), ["block", f"t{c}"]).withColumn(f"p{c}", F.explode(pieces)).withColumnRenamed("class", c).drop("pieces")
    squares = near.select("a", "pa", "b", "pb", "edits", (F.col("a") == F.col("b")).alias("own"))
    squares = kept(squares.withColumn("square", F.monotonically_increasing_id()), "squares")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    members = kept(rows.join(classes, ["block", "text"]).select("id", "class", piece.alias("piece")), "members")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't made less where rows are few: they stand for many pairs
    side = lambda c, x: members.select(F.col("id").alias(x), F.col("class").alias(c), F.col("piece").alias(f"p{c}"))
    left = squares.join(side("a", "x"), ["a", "pa"]).select("square", "own", "edits", "x").repartition(parts, "square")
    right = squares.join(side("b", "y"), ["b", "pb"]).select("square", "y").repartition(parts, "square")
    pairs = left.join(right, "square").where("x < y or (not own and x > y)")
    return pairs.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), "edits")


def fuzzy_classes(df: DataFrame, block: str, col: str, k: int) -> DataFrame:
    """P12 of a table with itself by classes: rows of equal block and text are one class, known by its least
    id. Links `(a_id, b_id, edits)` are those between classes at most `k` edits apart, and each other row's
    to its own class, with no edit. So copies never make all pairs."""
    rows = df.select("id", block, col).where(F.col(block).isNotNull() & F.col(col).isNotNull())
    classes = kept(rows.groupBy(block, col).agg(F.min("id").alias("a_id")), "classes")
    near = fuzzy_pairs(classes.withColumnRenamed("a_id", "id"), block, col, k)
    copies = rows.join(classes, [block, col]).where("id <> a_id").select("a_id", F.col("id").alias("b_id"), F.lit(0).alias("edits"))
    return near.unionByName(copies)


def dup_clusters(pairs: DataFrame) -> DataFrame:
    """`(id, cluster)` for each end of `pairs(a, b)`; the cluster is its least id."""
    return connected_components(pairs.select("a", "b")).select(F.col("node").alias("id"), F.col("root").alias("cluster"))


def golden_record(df: DataFrame, key: str, ts: str, ids: list[str], fields: list[str], price: str) -> DataFrame:
    """Of each field the latest value that isn't null, and the price's range and count."""
    order = F.struct(ts, *ids)
    latest = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields]
    return df.groupBy(key).agg(*latest, F.min(price).alias("lowest"), F.max(price).alias("highest"), F.count("*").alias("n_offers"))


def best_offers(offers: DataFrame, k: int) -> DataFrame:
    """The k cheapest retailers of each product, each by its lowest price."""
    lowest = offers.groupBy("product_id", "retailer_id").agg(F.min("unit_price_e4").alias("price_e4"))
    rank = F.row_number().over(W.partitionBy("product_id").orderBy("price_e4", "retailer_id"))
    return lowest.withColumn("rank", rank).where(F.col("rank") <= k)


#: What P19 ranks by, each of a row (price_e4, seen, n) of a preference and a product.
MEASURES = {"price": "-price_e4", "recency": "datediff(seen, date '1970-01-01')", "matches": "n"}


def weighted(weights: dict[str, float], ends: Callable[[str, Column], tuple[Column, Column]]) -> Column:
    """Weighted sum of low price, recency and number of matches, each scaled to 0..1 between its ends."""
    parts = []
    for name, x in MEASURES.items():
        x = F.expr(x)
        low, high = ends(name, x)
        parts.append(F.lit(weights[name]) * F.coalesce(F.try_divide((x - low).cast("double"), (high - low).cast("double")), F.lit(0.0)))
    return reduce(lambda a, b: a + b, parts)


def best_scores(scored: DataFrame, group: str, k: int) -> DataFrame:
    """The k rows of each group with the highest score, at equal scores those with the lesser product."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col("score").desc(), "product_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(group, "product_id", "price_e4", "n", "score", "rank")


def rank_matches(matches: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """The k best products of each preference by weighted low price, recency and number of
    matches, each scaled to 0..1 within the preference."""
    one = matches.groupBy("pref_id", "product_id").agg(F.min("unit_price_e4").alias("price_e4"), F.max("observed_at").alias("seen"), F.count("*").alias("n"))
    own = W.partitionBy("pref_id")
    scored = one.withColumn("score", F.round(weighted(weights, lambda _, x: (F.min(x).over(own), F.max(x).over(own))), 6))
    return best_scores(scored, "pref_id", k)


#: Stands for no highest price, and for the price of an offer without one.
NO_LIMIT = (1 << 63) - 1


def price_steps(offers: DataFrame, least: int, most: int) -> DataFrame:
    """What a highest price between `least` and `most` sees of a product: from `since` to `until` it is the
    same lowest price, last day and number of offers. Rows are at most the offers, mostly far fewer."""
    since = F.greatest(F.coalesce("unit_price_e4", F.lit(NO_LIMIT)), F.lit(least))
    at = offers.select("product_id", "unit_price_e4", "observed_at", since.alias("since")).where(F.col("since") <= most).repartition("product_id")
    at = at.groupBy("product_id", "since").agg(F.min("unit_price_e4").alias("price_e4"), F.max("observed_at").alias("seen"), F.count("*").alias("n"))
    up = W.partitionBy("product_id").orderBy("since")
    upto = up.rowsBetween(W.unboundedPreceding, W.currentRow)
    so_far = [f(c).over(upto).alias(c) for f, c in ((F.min, "price_e4"), (F.max, "seen"), (F.sum, "n"))]
    return at.select("product_id", "since", F.coalesce(F.lead("since").over(up) - 1, F.lit(NO_LIMIT)).alias("until"), *so_far)


def rank_classes(classes: DataFrame, products: DataFrame, offers: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """P19 for `classes(class_id, name, brand, max_price_e4)`, one row each. A class and a product make one
    pair, and pairs grow with the square of the tables, so they are only ever made on the fly, and neither
    shuffled nor sorted: once for the ends of what is scaled, once for a bound that k products reach (of
    4 k parts of the products, the k-th best part), and once for those that reach it, which are ranked."""
    asking, fits = by_asks(classes, products)
    classes = kept(asking.select("ask", "class_id", F.coalesce("max_price_e4", F.lit(NO_LIMIT)).alias("most")), "classes")
    least, most = classes.agg(F.coalesce(F.min("most"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0))).first()
    times = fits.repartition("product_id").groupBy("ask", "product_id").agg(F.count("*").alias("times"))
    steps = kept(price_steps(offers, least, most).join(times, "product_id").withColumn("n", F.col("n") * F.col("times")).drop("times"), "steps")
    # Neighbouring asks lie together, so a task adds up few classes; a hot ask is many tasks.
    steps = kept(steps.repartitionByRange(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ask", "product_id"), "dealt")
    pairs = lambda rows: steps.join(rows, "ask").where("most between since and until")
    ends = [f(F.expr(x)).alias(f"{end}_{name}") for name, x in MEASURES.items() for end, f in (("low", F.min), ("high", F.max))]
    classes = kept(classes.join(pairs(classes).groupBy("class_id").agg(*ends), "class_id"), "ends")
    raw = weighted(weights, lambda name, _: (F.col(f"low_{name}"), F.col(f"high_{name}")))
    parts = pairs(classes).groupBy("class_id", F.pmod(F.xxhash64("product_id"), F.lit(4 * k)).alias("part")).agg(F.max(raw).alias("best"))
    bound = parts.groupBy("class_id").agg(F.get(F.sort_array(F.collect_list("best"), asc=False), F.lit(k - 1)).alias("bound"))
    near = pairs(kept(classes.join(bound, "class_id"), "bounds")).withColumn("raw", raw)
    near = near.where(F.col("bound").isNull() | (F.col("raw") >= F.col("bound") - 2e-6))  # what rounding can put at the bound's place
    return best_scores(near.withColumn("score", F.round("raw", 6)), "class_id", k)


def rank_searches(prefs: DataFrame, products: DataFrame, offers: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """P19 of what P2 finds: preferences with equal slots have equal ranks, so each class of them (see
    alike) is searched and ranked once; its k rows then go to all its members. Classes of preferences that
    have several rows each are ranked by what P2 finds for all of them."""
    slots = ["name", "brand", "max_price_e4"]
    first, members = alike(prefs, slots)
    first = kept(first.groupBy("pref_id").agg(F.collect_list(F.struct(*slots)).alias("s")).withColumnRenamed("pref_id", "class_id"), "first")
    ranked = rank_classes(first.where("size(s) = 1").select("class_id", F.inline("s")), products, offers, weights, k)
    several = first.where("size(s) > 1").select(F.col("class_id").alias("pref_id"), F.inline("s"))
    if not several.isEmpty():
        ranked = ranked.unionByName(rank_matches(search(several, products, offers), weights, k).withColumnRenamed("pref_id", "class_id"))
    return members.join(kept(ranked, "ranked"), "class_id").drop("class_id")


def price_ranks(offers: DataFrame) -> DataFrame:
    """P20: where each retailer's lowest price stands among a product's retailers."""
    lowest = offers.groupBy("product_id", "retailer_id").agg(F.min("unit_price_e4").alias("price_e4"))
    by_price = W.partitionBy("product_id").orderBy("price_e4")
    strict = W.partitionBy("product_id").orderBy("price_e4", "retailer_id")
    return lowest.select("*", F.rank().over(by_price).alias("rank"), F.dense_rank().over(by_price).alias("dense_rank"), F.round(F.percent_rank().over(by_price), 6).alias("percent_rank"), F.ntile(4).over(strict).alias("quartile"))


def uncovered(products: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products without any offer, and those with one."""
    return products.join(offers, "product_id", "left_anti"), products.join(offers, "product_id", "left_semi")


def offer_summary(df: DataFrame) -> DataFrame:
    """Offers by brand and retailer's nation, with subtotals; `level` tells which."""
    return df.rollup("p_brand", "n_name").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n_offers"), F.min("unit_price_e4").alias("lowest"), F.round(F.avg("unit_price_e4"), 4).alias("mean_price"))


def coverage(df: DataFrame) -> DataFrame:
    """Distinct products of each retailer, exact, and estimated by a sketch."""
    return df.groupBy("retailer_id").agg(F.count_distinct("product_id").alias("n_products"), F.approx_count_distinct("product_id").alias("approx_products"))
