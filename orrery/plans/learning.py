"""Registered queries of retrieval and learner data (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import learner as L
from orrery.operators import retrieval as R
from orrery.operators import validation as V
from orrery.plans.registry import register
from orrery.plans.series import r
from orrery.plans.validation import NORM, b32
from orrery.plans.views import RESPONSE, response, sql
from orrery.sources.shared import kept
from orrery.sources.tables import table

CHUNKS = r"""
cw as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from documents),
chunks as (select doc_id, (k0 // 80)::int as chunk_no, array_to_string(w[k0 + 1:k0 + 100], ' ') as text from cw, unnest(range(0, greatest(1, len(w) - 20), 80)) as t(k0) where len(w) > 0)"""


def chunks(spark, sf):
    return R.chunk(table(spark, sf, "documents"), 100, 20)


@register("r1_chunk", sql(CHUNKS, "select * from chunks"))
def r1(spark, sf):
    return chunks(spark, sf)


def bm25_sql(units: str, k: int, tag: str) -> str:
    """SQL of R2 and R3 over units(unit, text)."""
    return f"""
terms{tag} as (select unit, unnest(string_split({NORM}, ' ')) as term from {units}),
tf{tag} as (select unit, term, count(*) as tf from terms{tag} where term <> '' group by 1, 2),
stats{tag} as (select unit, term, tf, count(*) over (partition by term) as df, (sum(tf) over (partition by unit))::bigint as len from tf{tag}),
whole{tag} as (select count(*) as n, avg(len) as mean from (select distinct unit, len from stats{tag})),
qw{tag} as (select distinct item_id as query_id, unnest(string_split({NORM}, ' ')) as term from benchmark),
scored{tag} as (
  select query_id, unit, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean))), 6) as score
  from qw{tag} join stats{tag} using (term), whole{tag} where term <> '' group by 1, 2),
hits{tag} as (select * from (select *, (row_number() over (partition by query_id order by score desc, unit))::int as rank from scored{tag}) where rank <= {k})"""


DOC_UNITS = "du as (select doc_id as unit, text from documents)"
CHUNK_UNITS = CHUNKS + ",\ncu as (select doc_id * 1000 + chunk_no as unit, text from chunks)"


def queries_of(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def doc_hits(spark, sf, k=10):
    return R.bm25_topk(queries_of(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), "doc_id", k)


def chunk_hits(spark, sf, k=20):
    units = chunks(spark, sf).select(F.struct("doc_id", "chunk_no").alias("unit"), "text")
    return R.bm25_topk(queries_of(spark, sf), units, "unit", k)


@register("r2_term_stats", sql(DOC_UNITS, bm25_sql("du", 10, ""), "select unit as doc_id, term, tf, df, len from stats"))
def r2(spark, sf):
    return R.term_stats(table(spark, sf, "documents"), "doc_id")


@register("r3_bm25_topk", sql(DOC_UNITS, bm25_sql("du", 10, ""), "select query_id, unit as doc_id, score, rank from hits"))
def r3(spark, sf):
    return doc_hits(spark, sf)


COSINES = """
q as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 20 = 0),
c as (select query_id, vec_id, round(list_dot_product(a, embedding::double[]) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as score from q, embeddings where vec_id <> query_id)"""


def vectors(spark, sf):
    all_ = table(spark, sf, "embeddings")
    return all_.where("vec_id % 20 = 0"), all_


@register("r4_vector_topk", sql(COSINES, "select * from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from c) where rank <= 10"))
def r4(spark, sf):
    return R.vector_topk(*vectors(spark, sf), 10)


@register("r5_vector_topk_lists")
def r5(spark, sf):
    queries, all_ = vectors(spark, sf)
    return R.vector_topk_lists(queries, all_, 10)


@register("r5_vector_topk_codes", sql(COSINES, "select * from (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from c) where rank <= 10"))
def r5_codes(spark, sf):
    """Through the index of codes with all lists asked: what R4 finds."""
    return R.vector_topk_lists(*vectors(spark, sf), 10, probe=128)


@register("r5_index_quality")
def r5_quality(spark, sf):
    return r(R.index_quality(*vectors(spark, sf), 10), "recall", "code_share", "whole_share")


FUSED = """
best as (select query_id, unit // 1000 as doc_id, min(rank) as rank from hitsc group by 1, 2),
lists as (select query_id, unit as doc_id, rank from hits union all select * from best)"""


@register("r6_fuse", sql(DOC_UNITS, bm25_sql("du", 10, ""), CHUNK_UNITS, bm25_sql("cu", 20, "c"), FUSED, "select query_id, doc_id, round(sum(1 / (60 + rank)), 6) as score from lists group by 1, 2"))
def r6(spark, sf):
    best = chunk_hits(spark, sf).select("query_id", "unit.doc_id", "rank").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return R.fuse([doc_hits(spark, sf), best])


@register("r7_pack_context", sql(CHUNK_UNITS, bm25_sql("cu", 20, "c"), """
sized as (select query_id, rank, text, len(string_split(text, ' ')) as words from hitsc join cu using (unit)),
fit as (select * from (select *, sum(words) over (partition by query_id order by rank rows unbounded preceding) as total from sized) where total <= 350)""",
"select query_id, count(*) as n, sum(words)::bigint as words, string_agg(text, chr(10) order by rank) as context from fit group by 1"))
def r7(spark, sf):
    found = kept(chunk_hits(spark, sf), "hits")
    docs = table(spark, sf, "documents").join(found.select("unit.doc_id").distinct(), "doc_id", "left_semi")  # others have no hit
    units = R.chunk(docs, 100, 20).select(F.struct("doc_id", "chunk_no").alias("unit"), "text")
    hits = found.join(units, "unit").select("query_id", "rank", "text", F.size(F.split("text", " ")).alias("words"))
    return R.pack_context(hits, 350)


@register("r8_recent_turns", """
select conv_id, turn, memory from (select *, coalesce(list(text) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), []) as memory from conversations) where role = 'user'""")
def r8(spark, sf):
    return R.recent_turns(table(spark, sf, "conversations"), 3)


@register("r9_qa_pairs", """
select conv_id, turn, text as question, answer from (
  select *, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant'""")
def r9(spark, sf):
    return R.qa_pairs(table(spark, sf, "conversations"))


ALLOWED = "select distinct user_id from events where event_type = 'purchase'"


@register("r10_user_scope", f"select event_id, user_id, event_type, value from events where user_id in ({ALLOWED})")
def r10(spark, sf):
    events = table(spark, sf, "events")
    users = events.where("event_type = 'purchase'").select("user_id").distinct()
    return L.user_scope(events, users).select("event_id", "user_id", "event_type", "value")


@register("r10_profile", """
select user_id, sum(n)::bigint as n_events, array_to_string(list(event_type || '=' || n order by event_type), ',') as by_type from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def r10_profile(spark, sf):
    entries = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return L.profile(table(spark, sf, "events")).select("user_id", "n_events", F.array_join(entries, ",").alias("by_type"))


SESSIONS = """
marked as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '4 hours' then 0 else 1 end as new from events),
numbered as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from marked)"""
SESSION_ROWS = 'select user_id, min(ts) as start, max(ts) + interval \'4 hours\' as "end", count(*) as n, round(sum(value), 4) as total from numbered group by user_id, s'


@register("r11_sessions", sql(SESSIONS, SESSION_ROWS))
def r11(spark, sf):
    return r(L.sessions(table(spark, sf, "events"), "4 hours"), "total", places=4)


@register("r12_score", sql(RESPONSE, 'u as (select user_id, count(*) as n, sum(correct)::bigint as "right", round(100 * sum(correct) / count(*), 2) as percent from response group by 1)', "select *, round(percent_rank() over (order by percent), 6) as percent_rank from u"))
def r12(spark, sf):
    return r(L.score(response(spark, sf)), "percent_rank")


@register("r13_item_analysis", sql(RESPONSE, "u as (select user_id, sum(correct) as total from response group by 1)", """
select item_id, count(*) as n, round(avg(correct), 6) as difficulty, round(covar_pop(correct, total - correct) / nullif(stddev_pop(correct) * stddev_pop(total - correct), 0), 6) as discrimination from response join u using (user_id) group by 1"""))  # fmt: skip
def r13(spark, sf):
    return r(L.item_analysis(response(spark, sf)), "difficulty", "discrimination")


MASTERY = """
mastery as (
  select event_id, user_id, item_id % 5 as item_group, ts, round(avg(correct) over (w rows unbounded preceding), 6) as so_far, round(avg(correct) over (w rows between 4 preceding and current row), 6) as lately
  from response window w as (partition by user_id, item_id % 5 order by ts, event_id))"""


def mastery(spark, sf):
    return r(L.mastery(response(spark, sf), 5, 5), "so_far", "lately")


@register("r14_mastery", sql(RESPONSE, MASTERY, "select * from mastery"))
def r14(spark, sf):
    return mastery(spark, sf)


@register("r15_next_lesson", sql(RESPONSE, MASTERY, """
now as (select user_id, item_group, arg_max(lately, struct_pack(a := ts, b := event_id)) as lately from mastery group by 1, 2)""", """
select user_id, item_group, lately from (select *, row_number() over (partition by user_id order by lately, item_group) as n from now where lately < 0.8) where n = 1"""))  # fmt: skip
def r15(spark, sf):
    return L.next_lesson(mastery(spark, sf), 0.8)


FOLD = f"""
rows_ as (select d.doc_id, n_chars, quality, ({b32("'g1'", 'source')} % 4)::int as fold from documents d join labels using (doc_id)),
one as (
  select threshold, fold, avg(((n_chars > threshold)::int = quality)::int) as accuracy, avg((n_chars > threshold)::int) filter (quality = 1) as recall
  from rows_, (select unnest([200.0, 800.0, 2000.0])::double as threshold) group by 1, 2),
runs as (select threshold, fold, 'accuracy' as metric, accuracy as value from one union all select threshold, fold, 'recall', recall from one)"""


def runs(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return L.run_grid(V.group_kfold(rows, "source", 4, "g1"), [200, 800, 2000], "n_chars", "quality")


@register("r16_run_grid", sql(FOLD, "select threshold, fold, metric, round(value, 6) as value from runs"))
def r16(spark, sf):
    return r(runs(spark, sf), "value")


RIDGE = f"""
rows_ as (select l_quantity as x0, l_tax * 100 as x1, l_extendedprice / 1000 as y, ({b32("'g2'", 'l_orderkey')} % 4)::int as fold from lineitem),
sums as (select fold, count(*) as n, sum(x0) as a, sum(x1) as b, sum(y) as y, sum(x0 * x0) as aa, sum(x0 * x1) as ab, sum(x1 * x1) as bb, sum(x0 * y) as ay, sum(x1 * y) as by_ from rows_ group by fold),
rest as (
  select s.fold, sum(o.n) as n, sum(o.a) as a, sum(o.b) as b, sum(o.y) as y, sum(o.aa) as aa, sum(o.ab) as ab, sum(o.bb) as bb, sum(o.ay) as ay, sum(o.by_) as by_
  from sums s join sums o on s.fold <> o.fold group by s.fold),
centred as (select fold, ridge, n, a, b, y, aa - a * a / n + ridge as aa, ab - a * b / n as ab, bb - b * b / n + ridge as bb, ay - a * y / n as ay, by_ - b * y / n as by_ from rest, (select unnest([0.0, 1000.0, 1000000.0])::double as ridge)),
slopes as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as w0, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as w1 from centred),
errors as (select ridge, r.fold, r.y - (s.y / n + w0 * (x0 - a / n) + w1 * (x1 - b / n)) as e from rows_ r join slopes s using (fold)),
one as (select ridge, fold, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae from errors group by 1, 2),
ridge_runs as (select ridge, fold, 'rmse' as metric, rmse as value from one union all select ridge, fold, 'mae', mae from one)"""


def ridge_runs(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_tax") * 100).alias("tax"), (F.col("l_extendedprice") / 1000).alias("price"))
    return L.ridge_grid(V.group_kfold(rows, "l_orderkey", 4, "g2"), ["l_quantity", "tax"], "price", "fold", [0.0, 1000.0, 1000000.0])


@register("r16_ridge_grid", sql(RIDGE, "select ridge, fold, metric, round(value, 6) as value from ridge_runs"))
def r16_ridge(spark, sf):
    return r(ridge_runs(spark, sf), "value")


@register("r17_ridge_leaderboard", sql(RIDGE, """
wide as (select ridge, round(avg(value) filter (metric = 'rmse'), 6) as rmse_mean, round(stddev_samp(value) filter (metric = 'rmse'), 6) as rmse_sd,
  round(avg(value) filter (metric = 'mae'), 6) as mae_mean, round(stddev_samp(value) filter (metric = 'mae'), 6) as mae_sd from ridge_runs group by 1)""",
"select *, (rank() over (order by rmse_mean))::int as rank from wide"))
def r17_ridge(spark, sf):
    return L.leaderboard(ridge_runs(spark, sf), ["rmse", "mae"], "rmse", "ridge", up=True)


@register("r16_grid", "select distinct l_returnflag as config, s_nationkey as fold from lineitem, supplier")
def r16_grid(spark, sf):
    configs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("config")).distinct()
    folds = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("fold")).distinct()
    return L.grid(configs, folds)


@register("r17_leaderboard", sql(FOLD, """
wide as (select threshold, round(avg(value) filter (metric = 'accuracy'), 6) as accuracy_mean, round(stddev_samp(value) filter (metric = 'accuracy'), 6) as accuracy_sd,
  round(avg(value) filter (metric = 'recall'), 6) as recall_mean, round(stddev_samp(value) filter (metric = 'recall'), 6) as recall_sd from runs group by 1)""",
"select *, (rank() over (order by accuracy_mean desc))::int as rank from wide"))
def r17(spark, sf):
    return L.leaderboard(runs(spark, sf), ["accuracy", "recall"], "accuracy")


@register("r18_retrieval_metrics", sql(DOC_UNITS, bm25_sql("du", 10, ""), f"""
truth as (select item_id as query_id, doc_id from (select doc_id, ' ' || {NORM} || ' ' as body from documents) d, (select item_id, ' ' || {NORM} || ' ' as item from benchmark) i where contains(body, item)),
per as (
  select t.query_id, count(*) as relevant, count(rank) as hit, min(rank) as first, coalesce(sum(1 / log2(rank + 1.0::double)), 0) as dcg
  from truth t left join hits h on h.query_id = t.query_id and h.unit = t.doc_id group by 1)""", """
select query_id, round(hit / relevant, 6) as recall, round(hit / 10, 6) as precision, round(coalesce(1 / first, 0), 6) as mrr,
  round(dcg / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1 / log2(i + 1.0::double))), 6) as ndcg from per"""))  # fmt: skip
def r18(spark, sf):
    truth = V.contains_leak(table(spark, sf, "documents"), table(spark, sf, "benchmark")).withColumnRenamed("item_id", "query_id")
    return r(R.retrieval_metrics(doc_hits(spark, sf), truth, 10), "recall", "precision", "mrr", "ndcg")
