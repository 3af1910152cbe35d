"""Retrieval: chunks, term statistics, lexical and vector search, fusion, context, evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.columns import norm_text, word_counts
from orrery.sources.shared import kept, spread

K1, B = 1.2, 0.75  # usual constants of BM25
#: Rows and query vectors of a cell, which a task holds (4 and 8 bytes a dimension).
ROWS, HELD = 16_384, 4_096


def chunk(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """`(doc_id, chunk_no, text)`: runs of `size` words, each starting size - overlap after the
    last; a document without words has none."""
    words = df.select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - (overlap + 1)), F.lit(size - overlap))
    return words.select("doc_id", "w", F.posexplode(starts).alias("chunk_no", "at")).select("doc_id", "chunk_no", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("text"))


def term_stats(units: DataFrame, unit: str) -> DataFrame:
    """R2: `(unit, term, tf, df, len)` of the normalized words of each unit."""
    tf = word_counts(spread(units.select(unit, "text")), unit, norm_text(F.col("text"))).withColumnRenamed("unit", unit)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return tf.join(df, "term").select(unit, "term", "tf", "df", "len")


#: Length classes a doubling: units of a class have nearly the same length.
CLASSES = 1
#: Postings (per wanted hit) of a query's rarest terms that are scored for its first threshold, and
#: (per wanted hit) of those units, the best, that are scored in full. Any numbers give the same hits.
SEEDS, FULL = 50, 10
#: Scores are rounded to 6 places; bounds keep this far from the threshold.
MARGIN = 1e-5


def term_postings(words: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """`(unit, term, class, part, df)`: of each unit the terms that queries ask for, what each adds to
    a score, the class of the unit's length, and how many units have the term."""
    asked = kept(words.select("term").distinct().union(words.sparkSession.range(1).select(F.lit("").alias("term"))), "terms")
    counts = kept(word_counts(spread(units.select(unit, "text")), unit, norm_text(F.col("text")), marked=True).join(asked, "term", "left_semi"), "tf")
    tf, whole = counts.where("term <> ''"), counts.where("term = ''").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    place = F.floor(F.log2(F.col("len")) * CLASSES).cast("int")
    return tf.join(kept(df, "df"), "term").crossJoin(F.broadcast(whole)).select("unit", "term", place.alias("class"), part.alias("part"), "df")  # whole is one row


def best(scored: DataFrame, k: int) -> DataFrame:
    """`(query_id, unit, score)` with `rank` up to k; Spark ranks within tasks before it shuffles."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "unit"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def thresholds(words: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """`(query_id, least)`: a score that k units of the query reach, so its k-th best is no lower. The
    units with the best sums over the query's rarest terms are scored in full. Queries with fewer
    units get none."""
    df = postings.groupBy("term").agg(F.first("df").alias("df"))
    before = F.coalesce(F.sum("df").over(W.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rare = words.join(df, "term").withColumn("before", before).where(F.col("before") < SEEDS * k).select("query_id", "term")
    first = rare.join(postings.select("unit", "term", "part"), "term").groupBy("query_id", "unit").agg(F.sum("part").alias("score"))
    top = kept(best(first, FULL * k).select("query_id", "unit"), "seeds")
    whole = top.join(words, "query_id").join(postings.select("unit", "term", "part"), ["unit", "term"]).groupBy("query_id", "unit").agg(F.sum("part").alias("score"))
    return best(whole, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))


def steps(words: DataFrame, postings: DataFrame, least: DataFrame) -> DataFrame:
    """`(query_id, class, term, step, rest, least)`: a query's terms within each class of lengths, from
    the greatest possible part to the smallest. `rest` is the sum of the bounds from a term on.
    Step 0: a unit that has only terms from here on may still reach the threshold. Step 1: those
    after it, as long as the rest is half the threshold; step 2: the others."""
    bounds = postings.groupBy("term", "class").agg(F.max("part").alias("bound"))
    rest = F.sum("bound").over(W.partitionBy("query_id", "class").orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0))
    rows = words.join(bounds, "term").withColumn("rest", rest).join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    step = F.when(F.col("rest") >= F.col("least") - MARGIN, 0).when(F.col("rest") >= F.col("least") / 2, 1).otherwise(2)
    return rows.select("query_id", "class", "term", step.alias("step"), "rest", "least")


def bm25_stages(queries: DataFrame, units: DataFrame, unit: str, k: int) -> list[DataFrame]:
    """The pairs `(query_id, unit, class, score)` that are left after each step (see bm25_topk), with
    the scores so far; the last ones are whole."""
    words = kept(queries.select("query_id", F.explode(F.array_distinct(F.split(norm_text(F.col("text")), " "))).alias("term")).where("term <> ''"), "words")
    postings = kept(term_postings(words, units, unit), "postings")
    plan = kept(steps(words, postings, thresholds(words, postings, k)), "plan")
    terms = lambda s: plan.where(F.col("step") == s).select("query_id", "class", "term")
    now = terms(0).join(postings.select("unit", "term", "class", "part"), ["term", "class"]).groupBy("query_id", "unit", "class").agg(F.sum("part").alias("score"))
    # Further terms are looked up within a unit's own list: a pair stays one row, however many they are.
    numbers = kept(words.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    parts = postings.join(numbers, "term").repartition("unit").groupBy("unit", "number").agg(F.sum("part").alias("part"))
    lists = parts.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("number", "part"))).alias("have"))  # no more than a unit's words
    lists = kept(lists, "lists")
    more = F.aggregate(F.array_intersect("asked", F.map_keys("have")), F.lit(0.0), lambda s, n: s + F.element_at("have", n))
    out = []
    for step in (0, 1, 2):
        if step:
            asked = terms(step).join(numbers, "term").groupBy("query_id", "class").agg(F.collect_list("number").alias("asked"))
            now = now.join(asked, ["query_id", "class"], "left").join(lists, "unit")
            now = now.select("query_id", "unit", "class", (F.col("score") + F.coalesce(more, F.lit(0.0))).alias("score"))
        if step < 2:
            left = plan.groupBy("query_id", "class").agg(F.max("least").alias("least"), F.coalesce(F.max(F.when(F.col("step") > step, F.col("rest"))), F.lit(0.0)).alias("left"))
            now = now.join(left, ["query_id", "class"]).where(F.col("score") + F.col("left") >= F.col("least") - MARGIN).drop("left", "least")
        now = kept(now, f"pairs-{step}")
        out.append(now)
    return out


def bm25_topk(queries: DataFrame, units: DataFrame, unit: str, k: int) -> DataFrame:
    """`(query_id, <unit>, score, rank)`: the k best units of each query by BM25, ties to the lesser
    unit; scores have 6 places. Only words that some query asks for are counted.

    Terms have upper bounds, the greatest part that a unit of a class of lengths takes from them. A
    unit that has none of a query's terms with great bounds can't reach the query's threshold, so
    common words bring no candidates; they are looked up for those units alone that the terms
    before have left within reach. Pairs that fall short of the threshold even with all bounds of
    the terms to come are dropped after each of the first two steps. All hits are found."""
    scored = bm25_stages(queries, units, unit, k)[-1]
    found = best(scored.select("query_id", "unit", F.round("score", 6).alias("score")), k)
    return found.withColumnRenamed("unit", unit)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def cells(queries: DataFrame, vectors: DataFrame, carried: list[str], rows: int, held: int) -> tuple[DataFrame, DataFrame]:
    """`queries(query_id, embedding, list)`, `vectors(vec_id, carried..., list)` dealt into cells. A list is
    cut into pieces of about `rows` rows and blocks of about `held` queries; each pair of a piece and
    a block is a cell, which one task handles. So a list of any size, and any number of queries, is
    spread over tasks."""
    sizes = vectors.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("pieces"))
    asked = queries.groupBy("list").agg(F.ceil(F.count("*") / held).cast("int").alias("blocks"))
    plan = F.broadcast(kept(sizes.join(asked, "list"), "cells"))  # a row per list
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    v = vectors.join(plan, "list").select("list", mine("vec_id", "pieces").alias("piece"), spread("blocks").alias("block"), "vec_id", *carried)
    q = queries.join(plan, "list").select("list", spread("pieces").alias("piece"), mine("query_id", "blocks").alias("block"), F.col("query_id").alias("asker"), F.col("embedding").alias("asked"))
    return v, q


#: Rows and query vectors whose cosines are held at a time (8 bytes a pair). Any numbers give the same hits.
PART, BLOCK = 2048, 256


def merged(score: np.ndarray, found: np.ndarray, cosine: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query (a row of `score`, and of `found`, their ids) with further `cosine`s of the
    rows `names` taken in; ties to the lesser id. Places without a row are -inf."""
    k = score.shape[1]
    least = score.min(axis=1)
    if len(names) > k:
        least = np.maximum(least, np.partition(cosine, -k, axis=1)[:, -k])
    (p, q), (i, j) = np.nonzero(np.isfinite(score)), np.nonzero((cosine >= least[:, None]) & np.isfinite(cosine))
    of, s, n = np.concatenate([p, i]), np.concatenate([score[p, q], cosine[i, j]]), np.concatenate([found[p, q], names[j]])
    order = np.lexsort((n, -s, of))
    of, s, n = of[order], s[order], n[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    keep = place < k
    score, found = np.full(score.shape, -np.inf), np.zeros(found.shape, np.int64)
    score[of[keep], place[keep]], found[of[keep], place[keep]] = s[keep], n[keep]
    return score, found


def cells_topk(queries: DataFrame, vectors: DataFrame, k: int, rows: int, held: int) -> DataFrame:
    """`queries(query_id, embedding, list)`, `vectors(vec_id, embedding, list)` -> `(query_id, vec_id,
    score, rank)`: of each query the k nearest rows in the lists that it asks for, by cosine
    (rounded to 6 places; ties to the lesser id), its own row left out. Each cell gives k rows a
    query."""
    v, q = cells(queries, vectors, ["embedding"], rows, held)

    def nearest(own: pa.Table, asking: pa.Table) -> pa.Table:
        ids, n = asking.column("asker").to_numpy(), own.num_rows
        if not len(ids) or not n:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x = unit_rows(matrix(asking.column("asked").combine_chunks()))
        score, found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for lo in range(0, n, PART):
            part = own.slice(lo, PART)
            names = part.column("vec_id").to_numpy()
            y = unit_rows(matrix(part.column("embedding").combine_chunks())).T
            for b in range(0, len(ids), BLOCK):
                some = slice(b, b + BLOCK)
                cosine = np.round(x[some] @ y, 6)
                cosine[ids[some, None] == names[None, :]] = -np.inf
                score[some], found[some] = merged(score[some], found[some], cosine, names)
        i, j = np.nonzero(np.isfinite(score))
        return pa.table({"query_id": ids[i], "vec_id": found[i, j], "score": score[i, j]})

    keys = ["list", "piece", "block"]
    parts = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(nearest, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, rows: int = ROWS, held: int = HELD) -> DataFrame:
    """`(query_id, vec_id, score, rank)`: the k nearest of all rows by cosine (see cells_topk)."""
    one = F.lit(0).alias("list")
    asking = queries.select(F.col("vec_id").alias("query_id"), "embedding", one)
    return cells_topk(asking, vectors.select("vec_id", "embedding", one), k, rows, held)


def centroids(vectors: DataFrame, lists: int, sample: int = 20_000, seed: int = 3) -> np.ndarray:
    """Spherical k-means over at most `sample` rows, those with the least hashes of their ids."""
    rows = vectors.select("embedding", F.xxhash64(F.lit(seed), "vec_id").alias("h")).orderBy("h").limit(sample).select("embedding").collect()
    x = unit_rows(np.array([r[0] for r in rows], np.float64))
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(15):
        own = np.argmax(x @ c.T, axis=1)
        c = unit_rows(np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def in_lists(rows: DataFrame, id_col: str, centres: np.ndarray, probe: int) -> DataFrame:
    """`rows(id, embedding)` -> `(id, embedding, list)`: a row for each of the `probe` lists whose
    centroids are nearest."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(unit_rows(matrix(batch.column("embedding"))) @ shared.value.T), axis=1)[:, :probe]
            at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(at), batch.column("embedding").take(at), pa.array(near.ravel().astype(np.int32))], names=[id_col, "embedding", "list"])

    return rows.select(id_col, "embedding").mapInArrow(place, f"{id_col} bigint, embedding array<float>, list int")


def coded(rows: DataFrame) -> DataFrame:
    """`rows(vec_id, embedding, list)` -> `(vec_id, list, code BINARY, scale, error)`: each vector of length
    one as whole numbers from -127 to 127, a byte a dimension, times a scale; error is how far that
    is from the vector, so by Cauchy-Schwarz no cosine is further off."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(matrix(batch.column("embedding")))
            scale = np.abs(x).max(axis=1, initial=0) / 127
            code = np.rint(x / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
            error = np.linalg.norm(x - code * scale[:, None], axis=1)
            ends = pa.py_buffer((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
            codes = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("list"), codes, pa.array(scale), pa.array(error)], names=["vec_id", "list", "code", "scale", "error"])

    return rows.select("vec_id", "list", "embedding").mapInArrow(run, "vec_id bigint, list int, code binary, scale double, error double")


#: What single precision and rounding to 6 places may add to a code's error.
SLACK = 1e-5


def survivors(asking: DataFrame, codes: DataFrame, k: int, rows: int, held: int) -> DataFrame:
    """`asking(query_id, embedding, list)`, `codes` (see coded) -> `(query_id, vec_id)`: the rows of the
    queries' lists that may be among the k nearest. A cosine lies within the code's error of what the
    code gives; rows whose upper end is below k others' lower ends are out, first within each cell of
    a piece of a list and a block of queries, then over all cells of a query."""
    v, q = cells(asking, codes, ["code", "scale", "error"], rows, held)

    def near(own: pa.Table, queries: pa.Table) -> pa.Table:
        ids, out = queries.column("asker").to_numpy(), []
        if len(ids) and own.num_rows:
            x = unit_rows(matrix(queries.column("asked").combine_chunks())).astype(np.float32)
            top = np.full((len(ids), k), -np.inf, np.float32)
            for lo in range(0, own.num_rows, PART):
                part = own.slice(lo, PART)
                names, error = part.column("vec_id").to_numpy(), part.column("error").to_numpy() + SLACK
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(len(names), -1).T.astype(np.float32)
                scale = part.column("scale").to_numpy().astype(np.float32)
                for b in range(0, len(ids), BLOCK):
                    some = slice(b, b + BLOCK)
                    cosine = (x[some] @ code) * scale
                    cosine[ids[some, None] == names[None, :]] = -np.inf
                    top[some] = -np.partition(-np.concatenate([top[some], cosine - error.astype(np.float32)], 1), k - 1, axis=1)[:, :k]
                    i, j = np.nonzero((cosine + error >= top[some].min(axis=1)[:, None]) & np.isfinite(cosine))
                    out.append((i + b, names[j], cosine[i, j] - error[j], cosine[i, j] + error[j]))
            last = top.min(axis=1)
            out = [tuple(c[h >= last[i]] for c in (i, n, l, h)) for i, n, l, h in out]
        columns = [np.concatenate(c) if out else np.zeros(0) for c in (zip(*out, strict=True) if out else [()] * 4)]
        at = columns[0].astype(np.int64)
        return pa.table({"query_id": ids[at] if len(at) else pa.array([], pa.int64()), "vec_id": columns[1].astype(np.int64), "low": columns[2].astype(np.float64), "high": columns[3].astype(np.float64)})

    keys = ["list", "piece", "block"]
    found = kept(v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(near, "query_id bigint, vec_id bigint, low double, high double"), "near")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("low").desc()))
    least = found.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", F.col("low").alias("least"))
    return found.join(least, "query_id", "left").where("least is null or high >= least").select("query_id", "vec_id")


def reranked(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of the pairs `found(query_id, vec_id)`, by their whole vectors."""
    asked = found.join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), "query_id")
    pairs = asked.join(vectors.select("vec_id", F.col("embedding").alias("b")), "vec_id")

    def cosines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (unit_rows(matrix(batch.column(c))) for c in "ab")
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(np.round((a * b).sum(axis=1), 6))], names=["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "a", "b").mapInArrow(cosines, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_topk_lists(queries: DataFrame, vectors: DataFrame, k: int, lists: int = 128, probe: int = 64, rows: int = ROWS, held: int = HELD) -> DataFrame:
    """As R4 through an index of codes in lists: every row lies in the list of its nearest centroid, as
    a byte a dimension with an error bound, and a query is compared with the codes of its `probe`
    nearest lists only. The rows that the bounds leave, little more than k a query, are scored
    by their whole vectors, so within the lists asked the result is exact. With all lists asked
    it is R4's."""
    asking, index = placed(queries, vectors, lists, probe)
    return reranked(survivors(asking, coded(index), k, rows, held), queries, vectors, k)


def placed(queries: DataFrame, vectors: DataFrame, lists: int, probe: int) -> tuple[DataFrame, DataFrame]:
    """Queries in the lists that they ask for, and every row in its list."""
    c = centroids(vectors, lists)
    asking = in_lists(queries.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", c, probe)
    return kept(asking, "asking"), kept(in_lists(vectors, "vec_id", c, 1), "index")


def index_quality(queries: DataFrame, vectors: DataFrame, k: int, lists: int = 128, probe: int = 64) -> DataFrame:
    """One row: the exact neighbours, the share of them that the index finds, and the shares of all
    pairs of a query and a row that are scored by codes and by whole vectors."""
    asking, index = placed(queries, vectors, lists, probe)
    left = kept(survivors(asking, coded(index), k, ROWS, HELD), "survivors")
    own = index.groupBy("list").agg(F.count("*").alias("n")).join(asking.groupBy("list").agg(F.count("*").alias("m")), "list", "left")
    pairs = own.agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("scored"), F.sum("n").alias("rows"))
    asked = asking.agg((F.count("*") / min(probe, lists)).alias("queries"))
    whole = left.agg(F.count("*").alias("whole"))
    hit = recall(reranked(left, queries, vectors, k), vector_topk(queries, vectors, k))
    one = hit.crossJoin(pairs).crossJoin(asked).crossJoin(whole)  # one row each
    return one.select("n", "recall", (F.col("scored") / (F.col("rows") * F.col("queries"))).alias("code_share"), (F.col("whole") / (F.col("rows") * F.col("queries"))).alias("whole_share"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact lists' rows that were found."""
    keys = ["query_id", "vec_id"]
    hit = found.select(*keys).withColumn("hit", F.lit(1))
    return exact.select(*keys).join(hit, keys, "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def fuse(lists: list[DataFrame], c: int = 60) -> DataFrame:
    """`(query_id, doc_id, score)`: the sum of 1 / (c + rank) over ranked lists."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", "rank") for x in lists])
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(c) + F.col("rank"))), 6).alias("score"))


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """`hits(query_id, rank, text, words)` -> `(query_id, n, words, context)`: the best chunks as
    long as their words, summed by rank, stay within the budget."""
    total = F.sum("words").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    fit = hits.withColumn("total", total).where(F.col("total") <= budget)
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return fit.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("context"))


def recent_turns(df: DataFrame, n: int) -> DataFrame:
    """For each user turn the texts of the n turns before it, oldest first."""
    past = F.collect_list("text").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1))
    return df.withColumn("memory", past).where("role = 'user'").select("conv_id", "turn", "memory")


def qa_pairs(df: DataFrame) -> DataFrame:
    """User turns whose next turn is an assistant's."""
    order = W.partitionBy("conv_id").orderBy("turn")
    nexts = df.select("*", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"))
    return nexts.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def retrieval_metrics(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG at k per query with a known answer."""
    top = hits.where(F.col("rank") <= k)
    right = truth.select("query_id", "doc_id").distinct()
    found = right.join(top, ["query_id", "doc_id"], "left")
    per = found.groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("rank").alias("hit"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank").isNotNull(), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select("query_id", (F.col("hit") / F.col("relevant")).alias("recall"), (F.col("hit") / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
