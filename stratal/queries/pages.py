"""The dashboards' pages under their slicers, and their growth cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratal.queries import SQL, query
from stratal.queries.kpis import AS_OF, Q_ALL, Q_CONV, Q_LOST, Q_WON, STAR, _long_growth, _long_sql, div, one, plain, r, two
from stratal.queries.star import policies
from stratal.semantic.catalog import GROWTH, GROWTH_TWO, expressions
from stratal.semantic.context import Cube, running_distinct
from stratal.semantic.engine import arrow_label, column_name, sign_color
from stratal.semantic.pages import CARDS, PAGES, SLICERS, cards, choices, records, render, visuals
from stratal.session import staged

#: What is selected on every page: two years, three providers, and regions, which payments and cancellations do not have.
SELECTED = {"year_number": [1996, 1997], "provider_code": ["BV", "MIC", "PTI"], "region": ["AFRICA", "ASIA", "EUROPE"]}
_REACH = {"fq": ("year_number", "provider_code", "region"), "fp": ("year_number", "provider_code", "region"), "fpe": ("year_number", "provider_code", "region"), "fpay": ("year_number", "provider_code"), "fcan": ("year_number", "provider_code")}

_PAID = "count(*) FILTER (status = 'PAID')"
_SQL_ONE = {
    "Rejected Quotations": ("fq", "count(*) FILTER (status = 'REJECTED')"), "Expired Quotations": ("fq", "count(*) FILTER (status = 'EXPIRED')"), "Conversion Rate": ("fq", div(Q_CONV, Q_ALL)),
    "Lost Deal Analysis": ("fq", Q_LOST), "Total Quotations": ("fq", Q_ALL), "Quote-to-Accept Rate": ("fq", div(Q_WON, Q_ALL)), "Accepted Quotations": ("fq", Q_WON),
    "Avg Written Premium per Policy (VND)": ("fp", div("sum(premium_amount)", "count(*)")), "Active Agents": ("fq", "count(DISTINCT agent_id)"), "Policies Issued": ("fp", "count(*)"),
    "Policies In Force": ("fp", "count(*) FILTER (status = 'ACTIVE')"), "Active Customers": ("fp", "count(DISTINCT CASE WHEN status = 'ACTIVE' THEN customer_key END)"),
    "Total Written Premium (VND)": ("fp", "sum(premium_amount)"),
}
_SQL_TWO = {
    "Total Written Premium": ("fpe", "coalesce(sum(CASE WHEN status IN ('ACTIVE', 'EXPIRED') THEN premium_amount END), 0)"), "Total Written Premium (VND)": ("fpe", "sum(premium_amount)"),
    "Payment Collection Rate": ("fpay", div(_PAID, "count(*)")), "Total payment": ("fpay", "count(*)"), "Total Amount": ("fpay", "coalesce(sum(payment_amount), 0)"),
    "Successful Payment Rate": ("fpay", div(_PAID, "count(*)", "NULL")), "Failed Payment Rate": ("fpay", div("count(*) FILTER (status = 'FAILED')", "count(*)")),
    "Avg Payment Value": ("fpay", div("sum(payment_amount)", "count(*)", "NULL")), "Policies Issued": ("fpe", "count(*)"), "Expired Policies": ("fpe", "count(*) FILTER (status = 'EXPIRED')"),
    "Avg Premium per Policy": ("fpe", div("sum(premium_amount)", "count(*)", "NULL")), "Active Policies": ("fpe", "count(*) FILTER (status = 'ACTIVE')"),
    "Policies Expiring Soon": ("fpe", f"count(*) FILTER (status = 'ACTIVE' AND end_date <= DATE '{AS_OF}' + 30)"), "Cancelled Policies": ("fcan", "count(*)"),
    "Total Collected Premium": ("fpay", "coalesce(sum(CASE WHEN status = 'PAID' THEN payment_amount END), 0)"),
    "Active Providers": ("fpe", "count(DISTINCT provider_code)"), "Pending Aging Amount": ("fpay", "sum(CASE WHEN status = 'PENDING' THEN payment_amount END)"),
}


def _where(fact: str, but: tuple[str, ...] = ()) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return " AND ".join(f"{f} IN ({', '.join(map(quoted, SELECTED[f]))})" for f in _REACH[fact] if f not in but)


#: Measures that change the filters, as SQL over fq under the page's slicers.
_IN_CONTEXT = {
    "Volume Share by Provider": f"count(*)::DOUBLE / (SELECT count(*) FROM fq WHERE {_where('fq', ('provider_code',))}) * 100",
    "Agent vs Regional Benchmark": f"{Q_CONV}::DOUBLE / {Q_ALL} - (SELECT {Q_CONV}::DOUBLE / {Q_ALL} FROM fq WHERE {_where('fq')})",
    "Average Conversion Rate (Agent)": f"(SELECT avg(x) FROM (SELECT {Q_CONV}::DOUBLE / {Q_ALL} AS x FROM fq WHERE {_where('fq')} GROUP BY agent_id)) + 0 * count(*)",
}


def _page_sql(page: str, measures: dict[str, tuple[str, str]]) -> str:
    parts = []
    for i, v in enumerate(visuals(page), 1):
        category = " || ' | ' || ".join(f"coalesce({b}::VARCHAR, '')" for b in v.by) or "''"
        group = f" GROUP BY {', '.join(v.by)}" if v.by else ""
        for m in v.measures:
            if m == "Policy Cancellation Rate":  # cancellations over policies, each summed on its own
                side = lambda f, n: f"(SELECT {category} AS category, count(*) AS {n} FROM {f} WHERE {_where(f)}{group})"
                parts.append(f"SELECT {i} AS visual, coalesce(p.category, c.category) AS category, '{m}' AS measure, {r(div('coalesce(c, 0)', 'coalesce(p, 0)'))} AS value FROM {side('fpe', 'p')} AS p FULL JOIN {side('fcan', 'c')} AS c ON p.category = c.category")
            else:
                fact, sql = ("fq", _IN_CONTEXT[m]) if m in _IN_CONTEXT else measures[m]
                parts.append(f"SELECT {i} AS visual, {category} AS category, '{m}' AS measure, {r(sql)} AS value FROM {fact} WHERE {_where(fact)}{group}")
                others = {measures[x][0] for x in v.measures if x in measures} - {fact}
                if v.by and others and (m == "Policies Issued" or "ELSE 0.0 END" in sql or sql.startswith("coalesce(")):  # zero for a group that only another fact has
                    there = " UNION ".join(f"SELECT DISTINCT {category} AS category FROM {f} WHERE {_where(f)}" for f in sorted(others))
                    parts.append(f"SELECT {i}, category, '{m}', 0.0 FROM ({there}) WHERE category NOT IN (SELECT {category} FROM {fact} WHERE {_where(fact)})")
    rising = ", ".join(str(i) for i, v in enumerate(visuals(page), 1) if v.by[:1] == ("year_number",)) or "0"
    first = " OR ".join(f"(visual = {i} AND measure = '{v.measures[0]}')" for i, v in enumerate(visuals(page), 1))
    number = lambda n: f"CASE WHEN visual IN ({rising}) THEN TRY_CAST(split_part(category, ' | ', {n}) AS INTEGER) END"
    return f"""
WITH {STAR}, x AS ({' UNION ALL '.join(parts)}), y AS (SELECT * FROM x WHERE value IS NOT NULL),
c AS (SELECT visual, category, max(CASE WHEN {first} THEN value END) AS v FROM y GROUP BY ALL),
p AS (SELECT visual, category, row_number() OVER (PARTITION BY visual ORDER BY {number(1)}, {number(2)}, CASE WHEN visual NOT IN ({rising}) THEN v END DESC NULLS LAST, category)::INTEGER AS position FROM c)
SELECT y.*, position FROM y JOIN p USING (visual, category)"""


def _page(name: str, of, measures: dict[str, tuple[str, str]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(render(of(spark, sf_dir), name, SELECTED))

    run.__name__ = f"page_{name}"
    run.__doc__ = f"The {name} page: each visual's numbers under the slicers."
    query(_page_sql(name, measures))(run)


for _name in PAGES:
    _first = _name in ("geography", "product", "agents", "overview")
    _page(_name, one if _first else two, _SQL_ONE if _first else _SQL_TWO)

#: The growth cards of dashboard one, by what they are of; the last is in points.
CARDS_ONE = {
    "Quotation Growth % YoY": "Total Quotations", "Accepted Quotations Growth % YoY": "Accepted Quotations", "Policies Issued Growth % YoY": "Policies Issued", "Policies In Force Growth % YoY": "Policies In Force",
    "Active Customer Growth % YoY": "Active Customers", "Premium Growth % YoY": "Total Written Premium (VND)", "Avg Premium Change % YoY": "Avg Written Premium per Policy (VND)", "Conversion Rate Change YoY": "Conversion Rate",
}
#: Those of dashboard two with a measure of one fact: label, value and what they are of.
CARDS_TWO = {n: (v, m) for n, (v, m, _) in GROWTH_TWO.items() if m != "Policy Cancellation Rate"}
_POINTS = ("Conversion Rate Change YoY", "Growth Payment Collection Rate %", "Growth Successful Payment Rate %", "Growth Failed Payment Rate %")


def _cards(m, names: dict[str, str]) -> DataFrame:
    """card, year_number, value, prior, growth."""
    found = _long_growth(m, {v: f"c{i}" for i, v in enumerate(names.values())}, tuple(f"c{i}" for i, n in enumerate(names) if n in _POINTS))
    pick = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (f"c{i}", n)))
    return found.withColumn("card", pick[F.col("measure")]).drop("measure")


def _cards_sql(names: dict[str, str], measures: dict[str, tuple[str, str]]) -> str:
    facts: dict[str, list[tuple[str, str]]] = {}
    for card, m in names.items():
        facts.setdefault(measures[m][0], []).append((card, measures[m][1]))
    return _long_sql(list(facts.items()), _POINTS)


_FMT = lambda x, n: f"printf('%.{n}f', round({x}, {n}))"  # noqa: E731  (halves go away from zero)
_IS_POINTS = f"measure IN ({', '.join(repr(p) for p in _POINTS)})"


@query(f"""
WITH g AS ({_cards_sql(CARDS_ONE, _SQL_ONE)})
SELECT measure, year_number, growth AS number, NULL::VARCHAR AS text FROM g
UNION ALL SELECT measure || ' Display', year_number, NULL, CASE WHEN growth IS NOT NULL THEN CASE WHEN growth >= 0 THEN '▲ ' ELSE '▼ ' END || {_FMT('growth * 100', 2)} || CASE WHEN {_IS_POINTS} THEN ' pts vs PY' ELSE '% vs PY' END END FROM g
UNION ALL SELECT measure || ' Color', year_number, NULL, CASE WHEN coalesce(growth, 0) >= 0 THEN '#27AE60' ELSE '#E74C3C' END FROM g
""")
def kpi_growth_cards_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each growth card of dashboard one with its display and its color: 24 measures by year."""
    g = _cards(one(spark, sf_dir), CARDS_ONE)
    points = F.col("card").isin(*_POINTS)
    display = F.when(points, arrow_label(F.col("growth"), " pts")).otherwise(arrow_label(F.col("growth")))
    none = F.lit(None)
    rows = F.array(
        F.struct(F.col("card").alias("measure"), F.col("growth").alias("number"), none.cast("string").alias("text")),
        F.struct(F.concat("card", F.lit(" Display")).alias("measure"), none.cast("double").alias("number"), display.alias("text")),
        F.struct(F.concat("card", F.lit(" Color")).alias("measure"), none.cast("double").alias("number"), sign_color(F.col("growth")).alias("text")),
    )
    return g.select("year_number", F.explode(rows).alias("x")).select("x.measure", "year_number", "x.number", "x.text")


@query(SQL["kpi_growth_cards_one"])
def kpi_growth_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth cards as expressions over the year before, from one scan of each fact."""
    m = one(spark, sf_dir)
    known = {f"{n}{x}": expressions(m)[f"{n}{x}"] for n in GROWTH for x in ("", " Display", " Color")}
    cube = Cube(m)
    for e in known.values():
        cube.add(e, ("year_number",))
    wide = cube.frame({f"m{i}": e for i, e in enumerate(known.values())}, ("year_number",))
    rows = F.array(*(F.struct(F.lit(n).alias("measure"), (F.lit(None).cast("double") if n not in GROWTH else F.round(f"m{i}", 6)).alias("number"), (F.lit(None) if n in GROWTH else F.col(f"m{i}")).cast("string").alias("text")) for i, n in enumerate(known)))
    return wide.select("year_number", F.explode(rows).alias("x")).select("x.measure", "year_number", "x.number", "x.text")


def _evaluated(m, names: list[str], by: list[str], where: list[str] | None = None) -> DataFrame:
    cube, known = Cube(m, where or []), expressions(m)
    for n in names:
        cube.add(known[n], tuple(by))
    return cube.frame({column_name(n): known[n] for n in names}, tuple(by))


@query(f"""
WITH {STAR}, a AS (SELECT region, agent_name, agent_id, {Q_CONV} AS c, {Q_ALL} AS n FROM fq WHERE year_number IN (1996, 1997) GROUP BY ALL),
w AS (SELECT *, c::DOUBLE / n AS own, (sum(c) OVER (PARTITION BY region))::DOUBLE / sum(n) OVER (PARTITION BY region) AS benchmark FROM a),
i AS (SELECT agent_id, count(*) AS issued FROM fp WHERE year_number IN (1996, 1997) GROUP BY 1)
SELECT region, agent_name, agent_id, {r('own')} AS conversion_rate, {r('benchmark')} AS conv_rate_by_region, {r('own - benchmark')} AS agent_vs_regional_benchmark,
       CASE WHEN own - benchmark < 0 THEN '#FF6666' ELSE '#32CD32' END AS benchmark_color, issued AS policies_issued_by_agent FROM w LEFT JOIN i USING (agent_id)
""")
def kpi_agents_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each agent against the region: the same rate without the filter on the agent."""
    names = ["Conversion Rate", "Conv Rate by Region", "Agent vs Regional Benchmark", "Benchmark Color", "Policies Issued by Agent"]
    return plain(_evaluated(one(spark, sf_dir), names, ["region", "agent_name", "agent_id"], ["year_number IN (1996, 1997)"]))


@query(f"""
WITH {STAR}, a AS (SELECT region, agent_name, agent_id, {Q_CONV}::DOUBLE / {Q_ALL} AS v FROM fq GROUP BY ALL),
p AS (SELECT region, agent_name, count(*) AS n FROM fp GROUP BY ALL),
t AS (SELECT region, max(agent_name) AS top_agent_name_policies, max(n) AS top_agent_policies_count FROM (SELECT *, rank() OVER (PARTITION BY region ORDER BY n DESC) AS k FROM p) WHERE k = 1 GROUP BY 1),
b AS (SELECT region, max(agent_name) AS best_conv_rate_agent_name FROM (SELECT *, rank() OVER (PARTITION BY region ORDER BY v DESC) AS k FROM a) WHERE k = 1 GROUP BY 1),
m AS (SELECT region, {r('avg(v)')} AS average_conversion_rate_agent FROM a GROUP BY 1)
SELECT * FROM m LEFT JOIN t USING (region) LEFT JOIN b USING (region)
""")
def kpi_best_agents_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best agents of each region with ties, and the mean over its agents."""
    names = ["Top Agent Name (Policies)", "Top Agent Policies Count", "Best Conv Rate Agent Name", "Average Conversion Rate (Agent)"]
    return plain(_evaluated(one(spark, sf_dir), names, ["region"]))


@query(f"""
WITH {STAR}, p AS (SELECT year_number, provider_code, count(*) AS n, sum(CASE WHEN status IN ('ACTIVE', 'EXPIRED') THEN premium_amount END) AS s FROM fpe WHERE provider_code <> 'UNKNOWN' GROUP BY ALL),
c AS (SELECT year_number, provider_code, count(*) AS n FROM fcan WHERE provider_code <> 'UNKNOWN' GROUP BY ALL),
pay AS (SELECT year_number, provider_code, count(*) FILTER (status = 'PAID')::DOUBLE / count(*) AS v FROM fpay GROUP BY ALL),
x AS (
  SELECT coalesce(p.year_number, c.year_number) AS year_number, coalesce(p.provider_code, c.provider_code) AS provider_code,
         CASE WHEN coalesce(p.n, 0) <> 0 THEN coalesce(c.n, 0)::DOUBLE / p.n ELSE 0.0 END AS cancel
  FROM p FULL JOIN c ON p.year_number = c.year_number AND p.provider_code = c.provider_code),
y AS (SELECT DISTINCT year_number FROM fpe UNION SELECT year_number FROM fcan UNION SELECT year_number FROM fpay),
a AS (SELECT year_number, max(provider_code) AS top_premium_provider FROM (SELECT *, rank() OVER (PARTITION BY year_number ORDER BY s DESC) AS k FROM (SELECT year_number, provider_code, coalesce(s, 0) AS s FROM p)) WHERE k = 1 GROUP BY 1),
b AS (SELECT year_number, string_agg(provider_code, ', ' ORDER BY provider_code) AS best_collection_rate_provider FROM (SELECT *, rank() OVER (PARTITION BY year_number ORDER BY v DESC) AS k FROM pay) WHERE k = 1 GROUP BY 1),
d AS (SELECT year_number, max(provider_code) AS highest_cancel_rate_provider FROM (SELECT *, rank() OVER (PARTITION BY year_number ORDER BY cancel DESC) AS k FROM x) WHERE k = 1 GROUP BY 1)
SELECT year_number, top_premium_provider, best_collection_rate_provider, highest_cancel_rate_provider FROM (SELECT DISTINCT year_number FROM fpe) LEFT JOIN a USING (year_number) LEFT JOIN b USING (year_number) LEFT JOIN d USING (year_number)
""")
def kpi_best_providers_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and worst providers of each year in which policies end, ties named together or by the last name."""
    return _evaluated(two(spark, sf_dir), ["Top Premium Provider", "Best Collection Rate Provider", "Highest Cancel Rate Provider"], ["year_number"])


@query(f"""
WITH {STAR}, q AS (SELECT region, provider_code, status, {Q_ALL} AS n FROM fq WHERE provider_code IN ('BV', 'PTI') GROUP BY ALL),
s AS (SELECT region, count(*) AS n FROM fq GROUP BY 1),
f AS (SELECT region, status, count(*) AS n FROM fp WHERE provider_code IN ('BV', 'PTI') GROUP BY ALL)
SELECT 'volume' AS share, q.region, q.provider_code AS member, {r('sum(q.n)::DOUBLE / any_value(s.n) * 100')} AS value FROM q JOIN s USING (region) GROUP BY ALL
UNION ALL SELECT 'status', region, status, {r('n::DOUBLE / sum(n) OVER (PARTITION BY region)')} FROM f
""")
def kpi_shares_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a total from which a filter is taken: of providers (the slicer on providers goes too), and of statuses."""
    where = ["provider_code IN ('BV', 'PTI')"]
    a = _evaluated(one(spark, sf_dir), ["Volume Share by Provider"], ["region", "provider_code"], where).toDF("region", "member", "value").withColumn("share", F.lit("volume"))
    b = _evaluated(one(spark, sf_dir), ["Policy Status Distribution"], ["region", "status"], where).toDF("region", "member", "value").withColumn("share", F.lit("status"))
    return plain(a.unionByName(b))


@query(f"""
WITH {STAR}, d AS (SELECT region, full_date, year_month, {Q_ALL} AS n, {Q_CONV} AS c FROM fq GROUP BY ALL)
SELECT region, full_date::VARCHAR AS full_date, (sum(n) OVER w)::BIGINT AS quotation_count_by_month, {r('(sum(c) OVER w)::DOUBLE / sum(n) OVER w')} AS conversion_rate_by_month
FROM d WINDOW w AS (PARTITION BY region, year_month ORDER BY full_date)
""")
def kpi_month_to_date_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month to date by region and day."""
    return plain(_evaluated(one(spark, sf_dir), ["Quotation Count by Month", "Conversion Rate by Month"], ["region", "full_date"]))


@query(f"""
WITH {STAR}, a AS (SELECT region, issued_date AS d, customer_key FROM fp WHERE status IN ('ACTIVE', 'ISSUED')),
n AS (
  SELECT x.region, x.d, count(DISTINCT y.customer_key) AS n
  FROM (SELECT DISTINCT region, d FROM a) AS x JOIN a AS y ON x.region = y.region AND y.d <= x.d AND date_trunc('month', y.d) = date_trunc('month', x.d) GROUP BY ALL)
SELECT t.region, t.d::VARCHAR AS full_date, t.n AS customers, p.n AS last_year FROM n AS t LEFT JOIN n AS p ON t.region = p.region AND p.d = (t.d - INTERVAL 1 YEAR)::DATE
""")
def kpi_month_to_date_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different customers with policies from the month's first day to each day, beside the same period of the year before (of 29 February: up to the 28th)."""
    rows = policies(spark, sf_dir).where("status IN ('ACTIVE', 'ISSUED')").withColumn("full_date", F.col("issued_date"))
    n = staged(running_distinct(rows, ["region"], "customer_key"), "customers")
    before = n.select(F.col("region").alias("_r"), F.col("full_date").alias("_d"), F.col("n").alias("last_year"))
    out = n.join(before, (F.col("region") == F.col("_r")) & (F.add_months("full_date", -12) == F.col("_d")), "left")
    return out.select("region", F.col("full_date").cast("string").alias("full_date"), F.col("n").alias("customers"), "last_year")


_TWO_LABELS = {label: m for label, (_, m) in CARDS_TWO.items()}
_VALUE_NAMES = "CASE measure " + " ".join(f"WHEN '{label}' THEN '{value}'" for label, (value, _) in CARDS_TWO.items()) + " END"


@query(f"""
WITH g AS ({_cards_sql(_TWO_LABELS, _SQL_TWO)}),
h AS (SELECT measure, year_number, coalesce(prior, 0) = 0 AS is_new, CASE WHEN {_IS_POINTS} THEN coalesce(value, 0) - prior ELSE (coalesce(value, 0) - prior) / prior END AS x FROM g)
SELECT {_VALUE_NAMES} AS measure, year_number, CASE WHEN NOT is_new THEN round(x, 6) END AS number, CASE WHEN is_new THEN 'New' END AS text FROM h
UNION ALL SELECT measure, year_number, NULL, CASE WHEN is_new THEN '🆕 New' ELSE CASE WHEN x > 0 THEN '▲ ' WHEN x < 0 THEN '▼ ' ELSE '▬ ' END || {_FMT('x * 100', 1)} || CASE WHEN {_IS_POINTS} THEN 'pts vs PY' ELSE '% vs PY' END END FROM h
UNION ALL SELECT 'Growth Policies Issued Icon', year_number, NULL, CASE WHEN is_new OR x >= 0 THEN '▲' ELSE '▼' END FROM h WHERE measure = 'Growth Policies Issued %'
""")
def kpi_growth_cards_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each growth value of dashboard two with its label: a prior of zero, or none, is New. 25 measures by year."""
    g = _cards(two(spark, sf_dir), _TWO_LABELS)
    points, new = F.col("card").isin(*_POINTS), F.coalesce("prior", F.lit(0.0)) == 0
    off = F.coalesce("value", F.lit(0.0)) - F.col("prior")
    x = F.when(points, off).otherwise(F.when(~new, off / F.col("prior")))
    arrow = F.when(x > 0, "▲ ").when(x < 0, "▼ ").otherwise("▬ ")
    label = F.when(new, "🆕 New").otherwise(F.concat(arrow, F.format_string("%.1f", x * 100), F.when(points, "pts vs PY").otherwise("% vs PY")))
    value_name = F.create_map(*(F.lit(v) for label, (value, _) in CARDS_TWO.items() for v in (label, value)))[F.col("card")]
    none = F.lit(None)
    rows = [
        F.struct(value_name.alias("measure"), F.when(~new, F.round(x, 6)).alias("number"), F.when(new, "New").alias("text")),
        F.struct(F.col("card").alias("measure"), none.cast("double").alias("number"), label.alias("text")),
    ]
    icon = F.struct(F.lit("Growth Policies Issued Icon").alias("measure"), none.cast("double").alias("number"), F.when(new | (x >= 0), "▲").otherwise("▼").alias("text"))
    every = F.when(F.col("card") == "Growth Policies Issued %", F.array(*rows, icon)).otherwise(F.array(*rows))
    return g.select("year_number", F.explode(every).alias("x")).select("x.measure", "year_number", "x.number", "x.text")


_GROWTH_PAGES = ("overview", "payments", "policies", "operations", "demo")
_OF_PAGE = ", ".join(f"('{p}', '{m}')" for p in _GROWTH_PAGES for m in CARDS[p] if m != "Growth Policy Cancellation Rate %")


@query(f"""
WITH one AS ({SQL["kpi_growth_cards_one"]}), two AS ({SQL["kpi_growth_cards_two"]}), g AS (SELECT * FROM one UNION ALL SELECT * FROM two), c(page, measure) AS (VALUES {_OF_PAGE})
SELECT page, measure, text FROM c JOIN g USING (measure) WHERE year_number = 1997
""")
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The growth cards of the pages, for one year."""
    out = None
    for p in _GROWTH_PAGES:
        rows = cards(one(spark, sf_dir) if p == "overview" else two(spark, sf_dir), p, [1997])
        out = rows if out is None else out.unionByName(rows)
    return out.where("measure <> 'Growth Policy Cancellation Rate %'")


@query(f"""
WITH {STAR}, p AS (SELECT *, status AS s FROM fp), s(page, field) AS (VALUES {", ".join(f"('{p}', '{f}')" for p, fs in SLICERS.items() for f in fs)}),
v AS ({" UNION ".join(f"SELECT '{f}' AS field, {f}::VARCHAR AS value FROM fp" for f in ("city", "year_number", "provider_code", "region", "status"))})
SELECT page, field, value FROM s JOIN v USING (field) WHERE value IS NOT NULL
""")
def page_slicers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's slicers offer."""
    out = None
    for p in SLICERS:
        rows = choices(one(spark, sf_dir), p).select(F.lit(p).alias("page"), "field", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {STAR} SELECT policy_id, provider_code, region, status, premium_amount::DOUBLE AS premium_amount FROM fpe WHERE {_where('fpe')}")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies behind the pages, row by row."""
    return plain(records(two(spark, sf_dir), SELECTED))
