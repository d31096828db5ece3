"""Measures of the semantic layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from stratal.queries import query
from stratal.queries.star import AS_OF, STAR, agents, facts, payments, policies, quotations, table, with_date
from stratal.semantic.catalog import dashboard_one, dashboard_two, growth
from stratal.semantic.engine import AGING, aging_bucket, arrow_label, divide, growth_label, restrict, sign_color, year_over_year


def plain(df: DataFrame) -> DataFrame:
    """Money and ratios as rounded doubles, dates as text."""
    out = []
    for c, t in df.dtypes:
        if t.startswith("decimal") or t == "double":
            out.append(F.round(F.col(c).cast("double"), 6).alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c) if t == "date" else F.col(c))
    return df.select(*out)


def one(spark: SparkSession, sf_dir: str):
    return dashboard_one(facts(spark, sf_dir), AS_OF)


def two(spark: SparkSession, sf_dir: str):
    return dashboard_two(facts(spark, sf_dir, "end_date"), AS_OF)


def r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def div(n: str, d: str, other: str = "0.0") -> str:
    return f"CASE WHEN ({d}) <> 0 AND ({n}) IS NOT NULL THEN ({n})::DOUBLE / ({d}) ELSE {other} END"


Q_ALL, Q_WON, Q_LOST = "count(*)", "count(*) FILTER (status IN ('ACCEPTED', 'CONVERTED'))", "count(*) FILTER (status IN ('REJECTED', 'EXPIRED'))"
Q_CONV = "count(*) FILTER (converted_flag)"


@query(f"""
WITH {STAR},
q AS (SELECT region, year_number, {Q_CONV} AS conv, {Q_ALL} AS n FROM fq GROUP BY ALL),
p AS (SELECT region, year_number, sum(premium_amount) AS s FROM fp GROUP BY ALL)
SELECT coalesce(q.region, p.region) AS region, coalesce(q.year_number, p.year_number) AS year_number,
       {r(div('conv', 'n'))} AS conversion_rate, {r('s')} AS total_written_premium_vnd
FROM q FULL JOIN p ON q.region = p.region AND q.year_number = p.year_number
""")
def kpi_conversion_and_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: conversion rate and written premium by region and year."""
    return plain(one(spark, sf_dir).evaluate(["Conversion Rate", "Total Written Premium (VND)"], ["region", "year_number"]))


@query(f"""
WITH {STAR},
q AS (
  SELECT year_number, {Q_ALL} AS n, {Q_WON} AS won, {Q_CONV} AS conv, {Q_LOST} AS lost, count(*) FILTER (status = 'REJECTED') AS rej,
         count(*) FILTER (status = 'EXPIRED') AS ex, count(DISTINCT agent_id) AS agents,
         avg(CASE WHEN status = 'QUOTED' THEN date_diff('day', full_date, DATE '{AS_OF}') END) AS age,
         sum(CASE WHEN status IN ('ACCEPTED', 'CONVERTED') THEN premium_amount END) AS won_premium
  FROM fq GROUP BY 1),
p AS (
  SELECT year_number, count(*) AS n, sum(premium_amount) AS premium, count(*) FILTER (status = 'ACTIVE') AS force,
         count(DISTINCT CASE WHEN status = 'ACTIVE' THEN customer_key END) AS customers
  FROM fp GROUP BY 1)
SELECT coalesce(q.year_number, p.year_number) AS year_number, q.n AS total_quotations, won AS accepted_quotations, coalesce(p.n, 0) AS policies_issued,
       {r(div('conv', 'q.n'))} AS conversion_rate, {r('premium')} AS total_written_premium_vnd, {r(div('premium', 'p.n'))} AS avg_written_premium_per_policy_vnd,
       customers AS active_customers, force AS policies_in_force, p.n - force AS funnel_drop_off_issued_to_in_force,
       {r(div('lost', 'q.n'))} AS rejected_expired_rate_by_month, rej AS rejected_quotations, ex AS expired_quotations, rej AS rejected_quotations_ops_view,
       {r(div('won', 'q.n'))} AS quote_to_accept_rate, {r(div('won', 'q.n') + ' * 100')} AS acceptance_rate,
       printf('%.1f', {div('won', 'q.n')} * 100) || '% Acceptance Rate' AS sub_acceptance_rate, {r(div('p.n', 'q.n') + ' * 100')} AS policies_issued_rate,
       {r('age')} AS quotation_age_day, lost AS lost_deal_analysis, agents AS active_agents, {r(div('force', 'q.n') + ' * 100')} AS in_force_rate,
       {r('coalesce(won_premium, 0) - coalesce(premium, 0)')} AS ntu_gap_vnd
FROM q FULL JOIN p ON q.year_number = p.year_number
""".replace("THEN (won)::DOUBLE / (q.n) ELSE 0.0 END * 100", "THEN (won)::DOUBLE / (q.n) * 100 ELSE 0.0 END").replace("THEN (p.n)::DOUBLE / (q.n) ELSE 0.0 END * 100", "THEN (p.n)::DOUBLE / (q.n) * 100 ELSE 0.0 END").replace("THEN (force)::DOUBLE / (q.n) ELSE 0.0 END * 100", "THEN (force)::DOUBLE / (q.n) * 100 ELSE 0.0 END"))
def kpi_sales_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales measures of dashboard one, by year; policies by issue date."""
    names = [
        "Total Quotations", "Accepted Quotations", "Policies Issued", "Conversion Rate", "Total Written Premium (VND)", "Avg Written Premium per Policy (VND)",
        "Active Customers", "Policies In Force", "Funnel Drop-off: Issued to In Force", "Rejected + Expired Rate by Month", "Rejected Quotations", "Expired Quotations",
        "Rejected Quotations (Ops View)", "Quote-to-Accept Rate", "Acceptance Rate", "Sub Acceptance Rate", "Policies Issued Rate", "Quotation Age (day)",
        "Lost Deal Analysis", "Active Agents", "In Force Rate", "NTU Gap (VND)",
    ]
    return plain(one(spark, sf_dir).evaluate(names, ["year_number"]))


_PAY = "sum(CASE WHEN status = '{0}' THEN payment_amount END)"
_AGE = f"date_diff('day', full_date, DATE '{AS_OF}')"
_LIMITS = [" AND ".join([f"{_AGE} >= {a}"] * (a is not None) + [f"{_AGE} <= {b}"] * (b is not None)) for _, a, b in AGING]
_AGING = ", ".join(f"sum(CASE WHEN status = 'PENDING' AND {x} THEN payment_amount END) AS a{i}" for i, x in enumerate(_LIMITS))
_AGING_NAMES = ["pending_aging_0_7_days", "pending_aging_8_30_days", "pending_aging_31_60_days", "pending_aging_61_90_days", "pending_aging_90_days"]
_OPS = f"""
pay AS (
  SELECT provider_code, count(*) AS n, count(*) FILTER (status = 'PAID') AS paid, count(*) FILTER (status = 'FAILED') AS failed, sum(payment_amount) AS total,
         {_PAY.format('PAID')} AS s_paid, {_PAY.format('PENDING')} AS s_pending, {_PAY.format('FAILED')} AS s_failed,
         avg(CASE WHEN status = 'PAID' AND payment_amount > 0 THEN date_diff('day', issued_date, full_date) END) AS days, {_AGING}
  FROM fpay GROUP BY 1),
can AS (SELECT provider_code, count(*) AS c, sum(refund_amount) AS refund FROM fcan GROUP BY 1)
"""
_OPS_NAMES = [
    "Active Policies", "Cancelled Policies", "Payment Collection Rate", "Total Written Premium", "Total Collected Premium", "Pending Payments (VND)", "Failed Payment Rate",
    "Monthly Collected Amount", "Monthly Pending Amount", "Monthly Failed Amount", "Monthly Policies Issued", "Monthly Cancellations", *(f"Pending Aging {a[0]}" for a in AGING),
    "Average Payment Time (Days)", "Policy Cancellation Rate", "Policies Expiring Soon", "Refund Amount", "Refund Rate",
]


def _ops_sql(policy: str, active: str, failed: int) -> str:
    aging = ", ".join(f"{r(f'a{i}')} AS {n}" for i, n in enumerate(_AGING_NAMES))
    return f"""
WITH {STAR}, {_OPS},
p AS (
  SELECT provider_code, count(*) AS p, count(*) FILTER ({active}) AS active, count(*) FILTER (status = 'EXPIRED') AS expired, sum(premium_amount) AS premium,
         sum(CASE WHEN status IN ('ACTIVE', 'EXPIRED') THEN premium_amount END) AS earned, min(start_date) AS start,
         count(*) FILTER (status = 'ACTIVE' AND end_date <= DATE '{AS_OF}' + 30) AS soon
  FROM {policy} GROUP BY 1)
SELECT p.provider_code, active AS active_policies, c AS cancelled_policies, {r('paid::DOUBLE / n')} AS payment_collection_rate, {r('earned')} AS total_written_premium,
       {r('s_paid')} AS total_collected_premium, {r('s_pending')} AS pending_payments_vnd, {r(f'failed::DOUBLE / n * {failed}')} AS failed_payment_rate,
       {r('s_paid')} AS monthly_collected_amount, {r('s_pending')} AS monthly_pending_amount, {r('s_failed')} AS monthly_failed_amount,
       p AS monthly_policies_issued, c AS monthly_cancellations, {aging}, {r('days')} AS average_payment_time_days,
       {r('c::DOUBLE / p')} AS policy_cancellation_rate, soon AS policies_expiring_soon, {r('refund')} AS refund_amount,
       {r('refund::DOUBLE / (refund + s_paid) * 100')} AS refund_rate"""


_OPS_JOIN = "\nFROM p JOIN pay USING (provider_code) JOIN can USING (provider_code)"


@query(_ops_sql("fp", f"status = 'ACTIVE' AND end_date >= DATE '{AS_OF}'", 100) + _OPS_JOIN)
def kpi_operations_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment and cancellation measures of dashboard one, by provider."""
    return plain(one(spark, sf_dir).evaluate(_OPS_NAMES, ["provider_code"]))


@query(
    _ops_sql("fpe", "status = 'ACTIVE'", 1).replace(f"{r('a0')}", r("coalesce(a0, 0)")).replace(f"{r('a1')}", r("coalesce(a1, 0)")).replace(f"{r('a2')}", r("coalesce(a2, 0)"))
    .replace(f"{r('a3')}", r("coalesce(a3, 0)")).replace(f"{r('a4')}", r("coalesce(a4, 0)"))
    + f""", expired AS expired_policies, {r('paid::DOUBLE / n')} AS successful_payment_rate, {r('total::DOUBLE / n')} AS avg_payment_value,
       {r('s_pending')} AS total_pending_premium, {r('s_failed')} AS total_failed_premium, start::VARCHAR AS policy_start_date,
       {r('premium::DOUBLE / p')} AS avg_premium_per_policy, {r('total')} AS total_amount, n AS total_payment""" + _OPS_JOIN
)
def kpi_operations_two_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment, policy and cancellation measures of dashboard two, by provider; blanks are zeros."""
    more = ["Expired Policies", "Successful Payment Rate", "Avg Payment Value", "Total Pending Premium", "Total Failed Premium", "Policy Start Date", "Avg Premium per Policy", "Total Amount", "Total payment"]
    return plain(two(spark, sf_dir).evaluate([*_OPS_NAMES, *more], ["provider_code"]))


@query(f"""
WITH {STAR}, q AS (SELECT year_number, {Q_ALL} AS n, {Q_CONV} AS c FROM fq GROUP BY 1), p AS (SELECT year_number, count(*) AS n, count(*) FILTER (status = 'ACTIVE') AS a FROM fpe GROUP BY 1)
SELECT coalesce(q.year_number, p.year_number) AS year_number, {r(div('q.c * 100', 'q.n'))} AS conversion_rate, coalesce(p.n, 0) AS policies_issued, a AS active_policies
FROM q FULL JOIN p ON q.year_number = p.year_number
""")
def kpi_role_playing_end_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard two counts policies in the year they end, and the conversion rate in percent."""
    return plain(two(spark, sf_dir).evaluate(["Conversion Rate", "Policies Issued", "Active Policies"], ["year_number"]))


def _growth_sql(fact: str, value: str, other: str = "NULL", difference: bool = False) -> str:
    g = "a.v - b.v" if difference else div("a.v - b.v", "b.v", other)
    return f"""
WITH {STAR}, v AS (SELECT year_number, {value} AS v FROM {fact} GROUP BY 1)
SELECT a.year_number, {r('a.v')} AS value, {r('b.v')} AS prior, {r(g)} AS growth
FROM v AS a LEFT JOIN v AS b ON a.year_number = b.year_number + 1
"""


def _grown(df: DataFrame) -> DataFrame:
    return plain(df.withColumns({c: F.col(c).cast("double") for c in ("value", "prior")}))


@query(_growth_sql("fq", Q_ALL))
def kpi_yoy_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(growth(one(spark, sf_dir), "Total Quotations"))


@query(_growth_sql("fp", "sum(premium_amount)::DOUBLE", "0.0"))
def kpi_yoy_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 0 where there is no prior year."""
    m = one(spark, sf_dir)
    m.measure("Premium", "premium", lambda p: p.cast("double"))
    return _grown(growth(m, "Premium", otherwise=0.0))


@query(_growth_sql("fq", f"{Q_CONV}::DOUBLE / {Q_ALL}", difference=True))
def kpi_yoy_conversion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(growth(one(spark, sf_dir), "Conversion Rate", difference=True))


@query(_growth_sql("fp", "count(*) FILTER (status = 'ACTIVE')"))
def kpi_yoy_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(growth(one(spark, sf_dir), "Policies In Force"))


@query(_growth_sql("fp", "count(DISTINCT CASE WHEN status = 'ACTIVE' THEN customer_key END)"))
def kpi_yoy_active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(growth(one(spark, sf_dir), "Active Customers"))


@query(_growth_sql("fpay", "count(*) FILTER (status = 'PAID')::DOUBLE / count(*)"))
def kpi_yoy_collection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(growth(two(spark, sf_dir), "Payment Collection Rate"))


@query(f"""
WITH {STAR}, v AS (SELECT year_number, count(*) AS v FROM fpe GROUP BY 1),
g AS (SELECT a.year_number, a.v, b.v AS p, (a.v - b.v)::DOUBLE / b.v AS g FROM v AS a LEFT JOIN v AS b ON a.year_number = b.year_number + 1)
SELECT year_number, CASE WHEN p IS NULL OR p = 0 THEN 'New' ELSE (CASE WHEN g >= 0 THEN '+' ELSE '-' END) || printf('%.2f', abs(g) * 100) || '%' END AS label,
       CASE WHEN g IS NOT NULL THEN (CASE WHEN g >= 0 THEN '▲ ' ELSE '▼ ' END) || printf('%.2f', g * 100) || '% vs PY' END AS display,
       CASE WHEN coalesce(g, 0) >= 0 THEN '#27AE60' ELSE '#E74C3C' END AS color, 'PY (' || (year_number - 1) || ')' AS prior_label
FROM g
""")
def kpi_growth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth as text, arrow and colour; New where there is no prior year."""
    g = growth(two(spark, sf_dir), "Policies Issued")
    return g.select(
        "year_number", growth_label(F.col("growth"), F.col("prior")).alias("label"), arrow_label(F.col("growth")).alias("display"),
        sign_color(F.col("growth")).alias("color"), F.concat(F.lit("PY ("), (F.col("year_number") - 1).cast("string"), F.lit(")")).alias("prior_label"),
    )


@query(f"""
WITH {STAR}, m AS (SELECT year_month, {Q_CONV}::DOUBLE / {Q_ALL} AS v FROM fq GROUP BY 1)
SELECT a.year_month, {r('a.v')} AS conversion_rate, {r('b.v')} AS previous, {r('a.v - b.v')} AS change
FROM m AS a LEFT JOIN m AS b ON b.year_month = strftime((a.year_month || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m')
""")
def kpi_mom_conversion_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the calendar month before; null without one."""
    m = one(spark, sf_dir).evaluate(["Conversion Rate"], ["year_month"])
    after = F.date_format(F.add_months(F.to_date(F.concat("year_month", F.lit("-01"))), 1), "yyyy-MM")
    prev = m.select(after.alias("_m"), F.col("conversion_rate").alias("previous"))
    out = m.join(prev, m["year_month"] == prev["_m"], "left").drop("_m")
    return plain(out.withColumn("change", F.col("conversion_rate") - F.col("previous")))


@query(f"""
WITH {STAR}, d AS (SELECT full_date, year_month, count(*) AS n, sum(premium_amount) AS s FROM (SELECT issued_date AS full_date, year_month, premium_amount FROM fp) GROUP BY ALL)
SELECT full_date::VARCHAR AS full_date, (sum(n) OVER w)::BIGINT AS policies_mtd, {r('sum(s) OVER w')} AS premium_mtd
FROM d WINDOW w AS (PARTITION BY year_month ORDER BY full_date ROWS UNBOUNDED PRECEDING)
""")
def kpi_month_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are summed first, so a month's window sees 31 rows at most."""
    m = one(spark, sf_dir).frame(["Policies Issued", "Total Written Premium (VND)"], ["full_date", "year_month"])
    w = Window.partitionBy("year_month").orderBy("full_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return plain(m.select("full_date", F.sum("p").over(w).alias("policies_mtd"), F.sum("premium").over(w).alias("premium_mtd")))


@query(f"WITH {STAR} SELECT provider_code, count(*) AS total_quotations, {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS volume_share FROM fq GROUP BY 1")
def kpi_share_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = one(spark, sf_dir)
    by, total = m.evaluate(["Total Quotations"], ["provider_code"]), m.evaluate(["Total Quotations"]).toDF("_all")
    return plain(by.join(F.broadcast(total)).select("provider_code", "total_quotations", (divide(F.col("total_quotations"), F.col("_all"), 0.0) * 100).alias("volume_share")))


@query(f"WITH {STAR} SELECT status, count(*) AS policies, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS policy_status_distribution FROM fp GROUP BY 1")
def kpi_policy_status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = policies(spark, sf_dir).groupBy("status").agg(F.count("*").alias("policies"))
    total = n.agg(F.sum("policies").alias("_all"))
    return plain(n.join(F.broadcast(total)).select("status", "policies", divide(F.col("policies"), F.col("_all"), 0.0).alias("policy_status_distribution")))


_AGENT = f"SELECT region, agent_name, {Q_CONV}::DOUBLE / {Q_ALL} AS rate, {Q_CONV} AS c, {Q_ALL} AS n FROM fq GROUP BY ALL"


@query(f"""
WITH {STAR}, a AS ({_AGENT}), b AS (SELECT region, sum(c)::DOUBLE / sum(n) AS bench FROM a GROUP BY 1)
SELECT region, agent_name, {r('rate')} AS conversion_rate, {r('bench')} AS conv_rate_by_region, {r('rate - bench')} AS agent_vs_regional_benchmark,
       CASE WHEN rate - bench < 0 THEN '#FF6666' ELSE '#32CD32' END AS benchmark_color
FROM a JOIN b USING (region)
""")
def kpi_agent_vs_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = one(spark, sf_dir)
    a, b = m.evaluate(["Conversion Rate"], ["region", "agent_name"]), m.evaluate(["Conversion Rate"], ["region"]).toDF("region", "conv_rate_by_region")
    gap = F.col("conversion_rate") - F.col("conv_rate_by_region")
    out = a.join(F.broadcast(b), "region").withColumn("agent_vs_regional_benchmark", gap)
    return plain(out.withColumn("benchmark_color", F.when(gap < 0, "#FF6666").otherwise("#32CD32")))


@query(f"""
WITH {STAR}, p AS (SELECT agent_name, count(*) AS pol FROM fp GROUP BY 1), a AS ({_AGENT}), g AS (SELECT agent_id, {Q_CONV}::DOUBLE / {Q_ALL} AS v FROM fq GROUP BY 1)
SELECT (SELECT max(agent_name) FROM p WHERE pol = (SELECT max(pol) FROM p)) AS top_agent_name_policies, (SELECT max(pol) FROM p) AS top_agent_policies_count,
       (SELECT max(agent_name) FROM a WHERE rate = (SELECT max(rate) FROM a)) AS best_conv_rate_agent_name, (SELECT {r('avg(v)')} FROM g) AS average_conversion_rate_agent
""")
def kpi_top_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ties of the greatest value, of which the last name in alphabetical order is shown."""
    m = one(spark, sf_dir)
    rows = m.evaluate(["Policies Issued", "Conversion Rate"], ["agent_id", "agent_name"])
    best = rows.agg(
        F.max(F.struct("policies_issued", "agent_name")).alias("p"), F.max(F.struct("conversion_rate", "agent_name")).alias("c"), F.avg("conversion_rate").alias("average_conversion_rate_agent")
    )
    return plain(best.select(
        F.col("p.agent_name").alias("top_agent_name_policies"), F.col("p.policies_issued").alias("top_agent_policies_count"),
        F.col("c.agent_name").alias("best_conv_rate_agent_name"), "average_conversion_rate_agent",
    ))


_PROV = f"""
WITH {STAR}, pr AS (SELECT provider_code, sum(premium_amount) AS s, count(*) AS p FROM fpe GROUP BY 1),
py AS (SELECT provider_code, round(count(*) FILTER (status = 'PAID')::DOUBLE / count(*), 3) AS v FROM fpay GROUP BY 1),
cn AS (SELECT provider_code, count(*)::DOUBLE / p AS v FROM fcan JOIN pr USING (provider_code) GROUP BY provider_code, p)
"""


@query(f"""{_PROV}
SELECT (SELECT CASE WHEN count(*) = 1 THEN max(provider_code) END FROM pr WHERE s = (SELECT max(s) FROM pr)) AS top_premium_provider,
       (SELECT string_agg(provider_code, ', ' ORDER BY provider_code) FROM py WHERE v = (SELECT max(v) FROM py)) AS best_collection_rate_provider,
       (SELECT CASE WHEN count(*) = 1 THEN max(provider_code) END FROM cn WHERE v = (SELECT max(v) FROM cn)) AS highest_cancel_rate_provider
""")
def kpi_best_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name, or blank on a tie; for the collection rate (to three places) all names of a tie."""
    m = two(spark, sf_dir)
    rows = m.evaluate(["Total Written Premium (VND)", "Payment Collection Rate", "Policy Cancellation Rate"], ["provider_code"])
    rows = rows.where(F.upper("provider_code") != "UNKNOWN").withColumn("rate", F.round("payment_collection_rate", 3))
    top = rows.agg(F.max("total_written_premium_vnd").alias("a"), F.max("rate").alias("b"), F.max("policy_cancellation_rate").alias("c"))
    tied = rows.join(F.broadcast(top)).agg(*(
        F.array_sort(F.collect_set(F.when(F.col(v) == F.col(t), F.col("provider_code")))).alias(n)
        for v, t, n in (("total_written_premium_vnd", "a", "x"), ("rate", "b", "y"), ("policy_cancellation_rate", "c", "z"))
    ))
    only = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    return tied.select(only("x").alias("top_premium_provider"), F.array_join("y", ", ").alias("best_collection_rate_provider"), only("z").alias("highest_cancel_rate_provider"))


_BUCKETS = ", ".join(f"('{n}', {i + 1})" for i, (n, _, _) in enumerate(AGING))


@query(f"""
WITH {STAR}, spine(aging_bucket, sort_order) AS (VALUES {_BUCKETS}),
x AS (SELECT CASE WHEN a <= 7 THEN 1 WHEN a <= 30 THEN 2 WHEN a <= 60 THEN 3 WHEN a <= 90 THEN 4 ELSE 5 END AS b, payment_amount FROM (SELECT {_AGE} AS a, * FROM fpay WHERE status = 'PENDING'))
SELECT aging_bucket, sort_order, {r('coalesce(sum(payment_amount), 0)')} AS pending_aging_amount FROM spine LEFT JOIN x ON b = sort_order GROUP BY ALL
""")
def kpi_aging_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket has a row, also without payments."""
    spine = spark.sql(f"SELECT * FROM VALUES {_BUCKETS} AS t(aging_bucket, sort_order)")
    pending = payments(spark, sf_dir).where("status = 'PENDING'").withColumn("b", aging_bucket(F.datediff(F.lit(AS_OF).cast("date"), "payment_date")))
    sums = pending.groupBy("b").agg(F.sum("payment_amount").alias("s"))
    out = spine.join(sums, spine["aging_bucket"] == sums["b"], "left")
    return plain(out.select("aging_bucket", "sort_order", F.coalesce("s", F.lit(0)).alias("pending_aging_amount")))


@query(f"WITH {STAR} SELECT city, {Q_LOST} AS lost_deals, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (status = 'EXPIRED') AS expired FROM fq GROUP BY 1")
def kpi_lost_deals_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).evaluate(["Lost Deal Analysis", "Rejected Quotations", "Expired Quotations"], ["city"]).toDF("city", "lost_deals", "rejected", "expired")


@query(f"""
WITH {STAR}, p AS (SELECT provider_code, sum(premium_amount)::DOUBLE / count(*) AS v FROM fp GROUP BY 1)
SELECT provider_code, package_code, count(*) AS total_quotations, {r(Q_CONV + '::DOUBLE / count(*)')} AS conversion_rate, {r('any_value(v)')} AS provider_avg_premium
FROM fq JOIN p USING (provider_code) GROUP BY ALL
""")
def kpi_provider_and_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = one(spark, sf_dir)
    a = m.evaluate(["Total Quotations", "Conversion Rate"], ["provider_code", "package_code"])
    b = m.evaluate(["Avg Written Premium per Policy (VND)"], ["provider_code"]).toDF("provider_code", "provider_avg_premium")
    return plain(a.join(F.broadcast(b), "provider_code"))


@query(f"""
WITH {STAR}, x AS (SELECT provider_code, year_number, status, sum(payment_amount) AS s FROM fpay GROUP BY ALL)
SELECT provider_code, year_number, {', '.join(r(f"max(CASE WHEN status = '{s}' THEN s END)") + f' AS {s.lower()}' for s in ('PAID', 'PENDING', 'FAILED', 'REFUNDED'))} FROM x GROUP BY ALL
""")
def kpi_payments_by_provider_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)["fact_payment"].fact
    out = f.groupBy("provider_code", "year_number").pivot("status", ["PAID", "PENDING", "FAILED", "REFUNDED"]).agg(F.sum("payment_amount"))
    return plain(out.toDF("provider_code", "year_number", "paid", "pending", "failed", "refunded"))


@query(f"WITH {STAR} SELECT agent_name, count(*) AS total_quotations, {r('sum(premium_amount)')} AS premium FROM fq WHERE agent_id IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7') GROUP BY 1")
def rls_agent_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one agent sees of the model: its own rows of each fact."""
    m = one(spark, sf_dir)
    m.base("q_premium", "fact_quotation", "sum(premium_amount)")
    m.measure("Premium", "q_premium", lambda c: c)
    m.secured = agents(spark, sf_dir).select(F.col("agent_name").alias("user_id"), "agent_id"), "agent_id"
    return plain(m.as_user("nation_7").evaluate(["Total Quotations", "Premium"], ["agent_name"]))


@query("SELECT c_custkey, o_orderkey AS policy_id, round(o_totalprice::DECIMAL(18,2)::DOUBLE, 6) AS premium_amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_custkey = 7")
def rls_customer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("CUS"), F.col("c_custkey").cast("string")).alias("user_id"), F.col("c_custkey").alias("customer_key"))
    f = restrict({"p": policies(spark, sf_dir)}, c, "customer_key", "cus7")["p"]
    return plain(f.select(F.col("customer_key").alias("c_custkey"), "policy_id", "premium_amount"))


@query(f"""
WITH {STAR} SELECT year_number, quarter(full_date)::INTEGER AS quarter, month_number, count(*) AS total_quotations FROM fq GROUP BY ALL
""")
def kpi_date_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_date(quotations(spark, sf_dir), "quoted_date")
    return f.groupBy("year_number", F.quarter("full_date").alias("quarter"), "month_number").agg(F.count("*").alias("total_quotations"))


def _long_growth(m, names: dict[str, str], difference: tuple[str, ...] = ()) -> DataFrame:
    """measure, year_number, value, prior, growth for several measures: all evaluated at once, then turned."""
    wide = m.evaluate(list(names), ["year_number"]).toDF("year_number", *names.values())
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in names.values())
    rows = wide.select("year_number", F.expr(f"stack({len(names)}, {pairs}) AS (measure, value)"))
    share = year_over_year(rows.where(~F.col("measure").isin(list(difference))), "year_number", "value", ["measure"])
    if not difference:
        return plain(share)
    return plain(share.unionByName(year_over_year(rows.where(F.col("measure").isin(list(difference))), "year_number", "value", ["measure"], difference=True)))


def _long_sql(parts: list[tuple[str, list[tuple[str, str]]]], difference: tuple[str, ...] = ()) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS measure, year_number, ({e})::DOUBLE AS v FROM {fact} GROUP BY year_number" for fact, es in parts for n, e in es)
    names = ", ".join(f"'{d}'" for d in difference) or "''"
    g = f"CASE WHEN a.measure IN ({names}) THEN a.v - b.v ELSE {div('a.v - b.v', 'b.v', 'NULL')} END"
    years = " UNION ".join(f"SELECT year_number FROM {fact}" for fact, _ in parts)
    spine = f"SELECT measure, year_number FROM (SELECT DISTINCT measure FROM x0), ({years})"
    return f"""
WITH {STAR}, x0 AS ({rows}), x AS (SELECT s.measure, s.year_number, x0.v FROM ({spine}) AS s LEFT JOIN x0 ON s.measure = x0.measure AND s.year_number = x0.year_number)
SELECT a.measure, a.year_number, {r('a.v')} AS value, {r('b.v')} AS prior, {r(g)} AS growth
FROM x AS a LEFT JOIN x AS b ON a.measure = b.measure AND a.year_number = b.year_number + 1
"""


@query(_long_sql([
    ("fq", [("quotations", Q_ALL), ("accepted", Q_WON), ("conversion", f"{Q_CONV}::DOUBLE / {Q_ALL}")]),
    ("fp", [("issued", "count(*)"), ("in_force", "count(*) FILTER (status = 'ACTIVE')"), ("customers", "count(DISTINCT CASE WHEN status = 'ACTIVE' THEN customer_key END)"),
            ("premium", "sum(premium_amount)"), ("avg_premium", "sum(premium_amount)::DOUBLE / count(*)")]),
], ("conversion",)))
def kpi_growth_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year-over-year measure of dashboard one; the conversion rate changes in points."""
    names = {
        "Total Quotations": "quotations", "Accepted Quotations": "accepted", "Conversion Rate": "conversion", "Policies Issued": "issued", "Policies In Force": "in_force",
        "Active Customers": "customers", "Total Written Premium (VND)": "premium", "Avg Written Premium per Policy (VND)": "avg_premium",
    }
    return _long_growth(one(spark, sf_dir), names, ("conversion",))


_SOON = f"count(*) FILTER (status = 'ACTIVE' AND end_date <= DATE '{AS_OF}' + 30)"


@query(_long_sql([
    ("fpe", [("active", "count(*) FILTER (status = 'ACTIVE')"), ("expired", "count(*) FILTER (status = 'EXPIRED')"), ("premium", "sum(premium_amount)"),
             ("avg_premium", "sum(premium_amount)::DOUBLE / count(*)"), ("soon", _SOON)]),
    ("fpay", [("total", "sum(payment_amount)"), ("rate", "count(*) FILTER (status = 'PAID')::DOUBLE / count(*)"), ("failed", "count(*) FILTER (status = 'FAILED')::DOUBLE / count(*)"),
              ("avg_value", "sum(payment_amount)::DOUBLE / count(*)"), ("collected", "sum(CASE WHEN status = 'PAID' THEN payment_amount END)")]),
]))
def kpi_growth_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-over-year measures of dashboard two."""
    names = {
        "Active Policies": "active", "Expired Policies": "expired", "Total Written Premium (VND)": "premium", "Avg Premium per Policy": "avg_premium", "Policies Expiring Soon": "soon",
        "Total payment amount": "total", "Successful Payment Rate": "rate", "Failed rate": "failed", "Avg Payment Value": "avg_value", "Collected Premium Revenue": "collected",
    }
    m = two(spark, sf_dir)
    m.measure("Total payment amount", "pay_total", lambda c: c)
    m.measure("Failed rate", "pay_failed pay", lambda n, d: divide(n, d))
    return _long_growth(m, names)


@query(f"""
WITH {STAR}, d AS (SELECT full_date, year_month, {Q_ALL} AS n, {Q_CONV} AS c FROM fq GROUP BY ALL)
SELECT full_date::VARCHAR AS full_date, (sum(n) OVER w)::BIGINT AS quotations_mtd, {r('(sum(c) OVER w)::DOUBLE / (sum(n) OVER w)')} AS conversion_mtd
FROM d WINDOW w AS (PARTITION BY year_month ORDER BY full_date ROWS UNBOUNDED PRECEDING)
""")
def kpi_month_to_date_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio to date is the ratio of the sums to date."""
    m = one(spark, sf_dir).frame(["Conversion Rate"], ["full_date", "year_month"])
    w = Window.partitionBy("year_month").orderBy("full_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, c = F.sum("q").over(w), F.sum("q_converted").over(w)
    return plain(m.select("full_date", n.alias("quotations_mtd"), divide(c, n, 0.0).alias("conversion_mtd")))


@query(f"""
WITH {STAR}
SELECT agent_name, count(*) AS total_quotations, {r(Q_CONV + '::DOUBLE / count(*)')} AS conversion_rate, {r('sum(premium_amount)')} AS premium FROM fq
WHERE year_number = 1997 AND provider_code IN ('BV', 'MIC') AND region = (SELECT min(r_name) FROM region) GROUP BY 1
""")
def visual_with_slicers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart: a field, measures, slicers, sorted by the first measure."""
    m = one(spark, sf_dir)
    m.base("q_premium", "fact_quotation", "sum(premium_amount)")
    m.measure("Premium", "q_premium", lambda c: c)
    first = table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    where = f"year_number = 1997 AND provider_code IN ('BV', 'MIC') AND region = '{first}'"
    return plain(m.evaluate(["Total Quotations", "Conversion Rate", "Premium"], ["agent_name"], where)).orderBy(F.desc("total_quotations"), "agent_name")


@query(f"WITH {STAR} SELECT package_code, count(*) AS total_quotations FROM fq GROUP BY 1")
def kpi_quotations_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(spark, sf_dir).evaluate(["Total Quotations"], ["package_code"])


@query(f"""
WITH {STAR}, q AS (SELECT agent_name, {Q_CONV}::DOUBLE / {Q_ALL} AS v FROM fq GROUP BY 1), p AS (SELECT agent_name, count(*) AS n, sum(premium_amount)::DOUBLE / count(*) AS a FROM fp GROUP BY 1)
SELECT q.agent_name, {r('v')} AS conversion_rate, {r('coalesce(a, 0)')} AS avg_written_premium_per_policy_vnd, coalesce(n, 0) AS policies_issued FROM q LEFT JOIN p ON q.agent_name = p.agent_name
""")
def kpi_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies issued, conversion rate and average premium by agent."""
    return plain(one(spark, sf_dir).evaluate(["Conversion Rate", "Avg Written Premium per Policy (VND)", "Policies Issued"], ["agent_name"]))


@query("SELECT count(DISTINCT s_name) AS active_providers FROM supplier WHERE s_acctbal >= 0 AND upper(s_name) <> 'UNKNOWN'")
def kpi_active_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known members of the dimension whose flag is set."""
    s = table(spark, sf_dir, "supplier").withColumn("active_flag", (F.col("s_acctbal") >= 0).cast("int"))
    return s.where("active_flag = 1 AND upper(s_name) <> 'UNKNOWN'").agg(F.count_distinct("s_name").alias("active_providers"))


@query(f"""
WITH {STAR}, k AS (SELECT quotation_id FROM fq WHERE quoted_date < DATE '1997-01-01' AND NOT (quoted_date < DATE '1995-06-01'))
SELECT year_number, count(*) AS policies_issued, {r('sum(premium_amount)')} AS total_written_premium_vnd FROM fpe WHERE policy_id IN (SELECT quotation_id FROM k) AND region = 'ASIA' GROUP BY 1
""")
def kpi_bidirectional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a field of quotations alone reaches the policies of these quotations, as in the second model."""
    m = two(spark, sf_dir)
    m.bridges["fact_policy"] = ("policy_id", "fact_quotation", "quotation_id")
    where = ["quoted_date < DATE'1997-01-01'", "NOT (quoted_date < DATE'1995-06-01')", "region = 'ASIA'"]
    return plain(m.evaluate(["Policies Issued", "Total Written Premium (VND)"], ["year_number"], where))


@query("SELECT c_custkey, c_name FROM customer WHERE upper(c_name) = (SELECT upper(c_name) FROM customer WHERE c_custkey = 3) ORDER BY c_custkey LIMIT 1")
def login_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member by its name, whatever the case."""
    c = table(spark, sf_dir, "customer")
    name = c.where("c_custkey = 3").agg(F.upper(F.first("c_name")).alias("n"))
    return c.join(F.broadcast(name), F.upper("c_name") == F.col("n")).orderBy("c_custkey").limit(1).select("c_custkey", "c_name")
