"""Registered queries of validation and evaluation (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.columns import POISSON
from orrery.operators import products as P
from orrery.operators import validation as V
from orrery.plans.products import NEAR
from orrery.plans.registry import register
from orrery.plans.series import r
from orrery.plans.views import sql
from orrery.sources.tables import table

B32 = "('0x' || substr(md5({}), 1, 8))::bigint"


def b32(*parts: str) -> str:
    return B32.format("concat_ws(':', " + ", ".join(f"({p})::varchar" for p in parts) + ")")


def draw(base: str, rep: str) -> str:
    """SQL of functions.columns.draw."""
    p = 2147483647
    x = f"(({base} + {rep}::bigint * 1000003) % {p})"
    y = f"(({x} * 48271 + {rep}::bigint * 40692) % {p})"
    z = f"(({y} * (({y} + 16807) % {p})) % {p})"
    w = f"(({z} * 69621 + {base}) % {p})"
    return f"(({w} * (({w} + 12345) % {p})) % {p})"


#: SQL of functions.columns.poisson_weight, over a draw u between 0 and 1.
WEIGHT = " ".join(f"when u < {c!r}::double then {k}" for k, c in enumerate(POISSON)) + " else 5"


SPLIT = f"""
split as (select doc_id, lang, source, n_chars, case when {b32("'s1'", 'source')} < {int(0.3 * 2**32)} then 'test' else 'train' end as split from documents)"""
JUDGED = """
judged as (select d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic from documents d join labels l using (doc_id))"""


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


def split(spark, sf):
    return V.family_holdout(docs(spark, sf), "source", 0.3, "s1")


def judged(spark, sf):
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")


@register("v1_family_holdout", sql(SPLIT, "select * from split"))
def v1(spark, sf):
    return split(spark, sf)


@register("v2_group_kfold", f"select doc_id, lang, source, n_chars, ({b32(chr(39) + 's2' + chr(39), 'source')} % 5)::int as fold from documents")
def v2(spark, sf):
    return V.group_kfold(docs(spark, sf), "source", 5, "s2")


@register("v3_leave_one_family_out", sql(JUDGED, """
select doc_id, source, quality, f as held_out, case when f = source then 'test' else 'train' end as split from judged, (select distinct source as f from judged)"""))  # fmt: skip
def v3(spark, sf):
    return V.leave_one_family_out(judged(spark, sf).select("doc_id", "source", "quality"), "source")


@register("v4_split_report", sql(SPLIT, """
j as (select split, source, quality from split join labels using (doc_id))""", """
select split, count(*) as n, count(distinct source) as families, round(avg(quality), 6) as rate, round(abs(avg(quality) - (select avg(quality) from j)), 6) as gap from j group by split"""))  # fmt: skip
def v4(spark, sf):
    return r(V.split_report(split(spark, sf).join(table(spark, sf, "labels"), "doc_id"), "source", "quality"), "rate", "gap")


@register("v5_key_overlap", sql(SPLIT, "select n_chars from split where split = 'train' intersect select n_chars from split where split = 'test'"))
def v5(spark, sf):
    s = split(spark, sf)
    return V.key_overlap(s.where("split = 'train'"), s.where("split = 'test'"), ["n_chars"])


NORM = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
GRAMS = f"""
dw as (select doc_id, list_filter(string_split({NORM}, ' '), lambda w: w <> '') as w from documents),
iw as (select item_id, list_filter(string_split({NORM}, ' '), lambda w: w <> '') as w from benchmark),
dg as (select distinct doc_id, array_to_string(w[i:i + 7], ' ') as run from dw, unnest(range(1, greatest(1, len(w) - 7) + 1)) as t(i) where len(w) > 0),
ig as (select distinct item_id, array_to_string(w[i:i + 7], ' ') as run from iw, unnest(range(1, greatest(1, len(w) - 7) + 1)) as t(i) where len(w) > 0)"""


@register("v6_ngram_leak", sql(GRAMS, "select item_id, doc_id, count(*) as shared from ig join dg using (run) group by all"))
def v6(spark, sf):
    return V.ngram_leak(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 8)


@register("v7_contains_leak", f"""
with d as (select doc_id, ' ' || {NORM} || ' ' as body from documents), i as (select item_id, ' ' || {NORM} || ' ' as item from benchmark)
select item_id, doc_id from d, i where contains(body, item)""")
def v7(spark, sf):
    return V.contains_leak(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("v8_neardup_leak", sql(NEAR, SPLIT, """
select a, b, x.split as split_a, y.split as split_b from near join split x on x.doc_id = a join split y on y.doc_id = b where x.split <> y.split"""))
def v8(spark, sf):
    pairs = P.near_dup_pairs(table(spark, sf, "documents"), "doc_id", "text")
    return V.neardup_leak(pairs, split(spark, sf).select(F.col("doc_id").alias("id"), "split"))


@register("v9_time_leak", """
select l_orderkey as order_key, count(*) filter (l_shipdate > o_orderdate) as n_late, count(*) as n from lineitem join orders on o_orderkey = l_orderkey group by 1 having n_late > 0""")
def v9(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_shipdate")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), "o_orderdate")
    return V.time_leak(lines, orders, "order_key", "l_shipdate", "o_orderdate")


@register("v10_decontaminate", sql(GRAMS, "select doc_id, lang, source, n_chars from documents where doc_id not in (select doc_id from ig join dg using (run))"))
def v10(spark, sf):
    leaked = V.ngram_leak(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 8)
    return V.decontaminate(docs(spark, sf), leaked, "doc_id")


def interval_sql(rows: str, by: str, seed: str, b: int, alpha: float) -> str:
    """SQL of bootstrap_ci over `rows(g, id, num, den)`."""
    return f"""
based as (select *, {b32(f"'{seed}'", "id")} as base from {rows}),
draws as (select *, {draw("base", "rep")} / 2147483647.0::double as u from based, range(0, {b + 1}) as t(rep)),
drawn as (select g, num, den, rep, case when rep = 0 then 1 {WEIGHT} end as w from draws),
sums as (select g, rep, sum(w * num) / nullif(sum(w * den), 0) as stat from drawn group by 1, 2),
ci as (select g as {by}, max(stat) filter (rep = 0) as est, quantile_cont(stat, {alpha / 2}) filter (rep > 0) as lo, quantile_cont(stat, {1 - alpha / 2}) filter (rep > 0) as hi, count(*) filter (rep > 0) as reps from sums group by g)"""


CI = "round(est, 8) as est, round(lo, 8) as lo, round(hi, 8) as hi"  # means of cents end in few digits: fewer places would meet ties


@register("v11_bootstrap_ci", sql("e as (select event_type as g, event_id as id, value::double as num, 1::double as den from events)", interval_sql("e", "event_type", "b1", 50, 0.05), f"select event_type, {CI}, reps from ci"))
def v11(spark, sf):
    return r(V.bootstrap_ci(table(spark, sf, "events"), "event_type", "event_id", F.col("value"), F.lit(1), 50, 0.05, "b1"), "est", "lo", "hi", places=8)


@register("v12_cluster_bootstrap_ci", sql(JUDGED, "e as (select 'all' as g, source as id, sum(quality)::double as num, count(*)::double as den from judged group by source)", interval_sql("e", "k", "b2", 200, 0.1), f"select {CI}, reps from ci"))
def v12(spark, sf):
    return r(V.cluster_bootstrap_ci(judged(spark, sf), "source", F.col("quality"), F.lit(1), 200, 0.1, "b2"), "est", "lo", "hi", places=8)


@register("v13_permutation_test", sql(JUDGED, f"""
k as (select lang, sum(quality) as k from judged group by lang),
based as (select *, {b32("'p1'", "doc_id")} as base from judged),
drawn as (select rep, lang, n_chars, row_number() over (partition by rep, lang order by {draw("base", "rep")}, doc_id) as place from based, range(1, 101) as t(rep)),
y as (select rep, case when place <= k then 1 else 0 end as y, n_chars from drawn join k using (lang) union all select 0, quality, n_chars from judged),
stats as (select rep, round(avg(n_chars) filter (y = 1) - avg(n_chars) filter (y = 0), 6) as stat from y group by rep)""", """
select e.stat as effect, round((1 + count(*) filter (abs(s.stat) >= abs(e.stat))) / (1 + count(*)), 6) as p, count(*) as reps
from stats s, (select stat from stats where rep = 0) e where s.rep > 0 group by e.stat"""))  # fmt: skip
def v13(spark, sf):
    return r(V.permutation_test(judged(spark, sf), "doc_id", "quality", "n_chars", "lang", 100, "p1"), "p")


@register("v14_sign_flip_test", f"""
with based as (select *, {b32("'f1'", "event_id")} as base from events),
drawn as (select event_type, rep, value - 50 as d, case when rep = 0 then 1 when {draw("base", "rep")} % 2 = 0 then 1 else -1 end as s from based, range(0, 41) as t(rep)),
stats as (select event_type, rep, round(avg(s * d), 6) as stat from drawn group by 1, 2)
select s.event_type, e.stat as effect, round((1 + count(*) filter (abs(s.stat) >= abs(e.stat))) / (1 + count(*)), 6) as p
from stats s join (select * from stats where rep = 0) e using (event_type) where s.rep > 0 group by 1, 2""")
def v14(spark, sf):
    rows = table(spark, sf, "events").withColumn("d", F.col("value") - 50)
    return r(V.sign_flip_test(rows, "event_type", "event_id", "d", 40, "f1"), "p")


PLACEBO = "e as (select event_type as g, event_id as id, (event_id % 2)::double as num, 1::double as den from events)"


@register("v15_negative_control", sql(PLACEBO, interval_sql("e", "event_type", "n1", 50, 0.05), f"select event_type, {CI}, reps, lo > 0.5 or hi < 0.5 as fails from ci"))
def v15(spark, sf):
    return r(V.negative_control(table(spark, sf, "events"), "event_type", "event_id", F.col("event_id") % 2, 0.5, 50, 0.05, "n1"), "est", "lo", "hi", places=8)


EFFECTS = "e as (select dayofmonth(ts)::int as g, event_id as id, (case when event_type = 'view' then value - 50 else 50 - value end)::double as num, 1::double as den from events)"


def effects(spark, sf):
    rows = table(spark, sf, "events").withColumn("day", F.dayofmonth("ts"))
    return V.replicate(rows, "day", "event_id", F.when(F.col("event_type") == "view", F.col("value") - 50).otherwise(50 - F.col("value")), 40, 0.05, "r1")


R1 = interval_sql("e", "day", "r1", 40, 0.05)


@register("v16_replicate", sql(EFFECTS, R1, f"select day, {CI}, reps, lo > 0 or hi < 0 as significant from ci"))
def v16(spark, sf):
    return r(effects(spark, sf), "est", "lo", "hi", places=8)


@register("v16_summary", sql(EFFECTS, R1, "m as (select quantile_cont(est, 0.5) as median from ci)", """
select round(median, 6) as median, count(*) as parts, round(avg(case when sign(est) = sign(median) then 1.0 else 0.0 end), 6) as agree, round(avg((lo > 0 or hi < 0)::int::double), 6) as share_significant from ci, m group by median"""))  # fmt: skip
def v16_summary(spark, sf):
    return r(V.replication_summary(effects(spark, sf)), "median", "agree", "share_significant")


@register("v17_pool", sql(EFFECTS, R1, """
w as (select est, 1 / pow((hi - lo) / (2 * 1.959963984540054), 2) as w from ci where hi > lo),
s as (select sum(w) as w, sum(w * est) as we, sum(w * est * est) as wee, count(*) as parts from w),
q as (select we / w as est, sqrt(1 / w) as se, greatest(0, wee - we * we / w) as q, parts from s)""", """
select round(est, 6) as est, round(se, 6) as se, round(q, 6) as q, parts, round(greatest(0, coalesce((q - (parts - 1)) / nullif(q, 0), 0)), 6) as i2 from q"""))  # fmt: skip
def v17(spark, sf):
    return r(V.pool(effects(spark, sf)), "est", "se", "q", "i2")


@register("v18_verdict", sql(EFFECTS, R1, f"""
select day, {CI}, case when lo >= -4 and hi <= 4 then 'equivalent' when lo > 0 then 'supported' when hi < 0 then 'refuted' else 'inconclusive' end as verdict from ci"""))  # fmt: skip
def v18(spark, sf):
    return r(V.verdict(effects(spark, sf), 4.0), "est", "lo", "hi", places=8).drop("reps", "significant")


@register("v19_bh_adjust", """
with tests as (select o_orderpriority as family, o_orderkey as id, round(o_totalprice - floor(o_totalprice), 2) as p from orders),
m as (select *, p * count(*) over (partition by family) / row_number() over (partition by family order by p, id) as raw from tests)
select family, id, p, round(least(1.0, min(raw) over (partition by family order by p desc, id desc rows unbounded preceding)), 6) as p_adjusted from m""")
def v19(spark, sf):
    tests = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") - F.floor("o_totalprice"), 2).alias("p"))
    return r(V.bh_adjust(tests, "family", "id"), "p_adjusted")


GUESS = JUDGED + """,
guess as (select *, case when n_chars > 1000 then 1 else 0 end as predicted, n_chars / (n_chars + 1500.0::double) as score from judged)"""


def guess(spark, sf):
    return judged(spark, sf).withColumns({"predicted": F.when(F.col("n_chars") > 1000, 1).otherwise(0), "score": F.col("n_chars") / (F.col("n_chars") + 1500.0)})


@register("v20_classification_report", sql(GUESS, """
c as (select count(*) filter (quality = 1 and predicted = 1)::double as tp, count(*) filter (quality = 0 and predicted = 1)::double as fp, count(*) filter (quality = 1 and predicted = 0)::double as fn, count(*) filter (quality = 0 and predicted = 0)::double as tn from guess)""", """
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1,
  round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) as accuracy, round((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 6) as mcc from c"""))  # fmt: skip
def v20(spark, sf):
    return r(V.classification_report(guess(spark, sf), "quality", "predicted"), "precision", "recall", "f1", "accuracy", "mcc")


AUC = """
c as (select {x} as s, sum({y}) as k, count(*) - sum({y}) as m from {t} group by 1),
u as (select k, m, coalesce(sum(m) over (order by s rows between unbounded preceding and 1 preceding), 0) as lower, sum(k) over (order by s desc rows unbounded preceding) as tp, sum(m) over (order by s desc rows unbounded preceding) as fp from c)"""


@register("v21_auc", sql(GUESS, AUC.format(x="score", y="quality", t="guess"), "select round(sum(k * (lower + m / 2)) / (sum(k) * sum(m)), 6) as auc, round(sum(k * tp / (tp + fp)) / sum(k), 6) as average_precision from u"))
def v21(spark, sf):
    return r(V.auc(guess(spark, sf), "score", "quality"), "auc", "average_precision")


BINS = """
bins as (select least(9, floor(score * 10))::int as bin, count(*) as n, avg(score) as mean_p, avg(quality::double) as rate, sum((score - quality) * (score - quality)) as squares from guess group by 1)"""


@register("v22_calibration", sql(GUESS, BINS, "select bin, n, round(mean_p, 6) as mean_p, round(rate, 6) as rate, round(squares, 6) as squares from bins"))
def v22(spark, sf):
    return r(V.calibration(guess(spark, sf), "score", "quality", 10), "mean_p", "rate", "squares")


@register("v22_errors", sql(GUESS, BINS, "select round(sum(squares) / sum(n), 6) as brier, round(sum(n * abs(mean_p - rate)) / sum(n), 6) as ece from bins"))
def v22_errors(spark, sf):
    return r(V.calibration_errors(V.calibration(guess(spark, sf), "score", "quality", 10)), "brier", "ece")


def screen_sql(x: str) -> str:
    return f"""(with {AUC.format(x=x, y='quality', t='judged').strip()}
select '{x}' as feature, (select round(corr({x}::double, quality::double), 6) from judged) as corr,
  (select round((avg({x}) filter (quality = 1) - avg({x}) filter (quality = 0)) / sqrt((var_samp({x}) filter (quality = 1) + var_samp({x}) filter (quality = 0)) / 2), 6) from judged) as difference,
  round(sum(k * (lower + m / 2)) / (sum(k) * sum(m)), 6) as auc from u)"""


@register("v23_feature_screen", sql(JUDGED, " union all ".join(screen_sql(x) for x in ("n_chars", "toxic", "doc_id"))))
def v23(spark, sf):
    return r(V.feature_screen(judged(spark, sf), ["n_chars", "toxic", "doc_id"], "quality"), "corr", "difference", "auc")
