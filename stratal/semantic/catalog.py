"""The measures of both dashboards. Names that both have differ in scale, role or blanks, so each has its own model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratal.functions.columns import divide
from stratal.semantic.context import Each, Expr, Leaf, Op, Prior, Remove, Role, ToDate, Where, of
from stratal.semantic.engine import AGING, Model, arrow_label, ratio, sign_color, year_over_year

LOST = "status IN ('REJECTED', 'EXPIRED')"
WON = "status IN ('ACCEPTED', 'CONVERTED')"


def same(c: Column) -> Column:
    return c


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _bases(m: Model, as_of: str, active_policies: str) -> None:
    """``as_of`` is the day of the report."""
    q, p, pay, can = "fact_quotation", "fact_policy", "fact_payment", "fact_cancellation"
    for name, condition in {"q": "true", "q_won": WON, "q_converted": "converted_flag", "q_lost": LOST, "q_rejected": "status = 'REJECTED'", "q_expired": "status = 'EXPIRED'"}.items():
        m.base(name, q, f"count_if({condition})")
    m.base("q_agents", q, "count(DISTINCT agent_id)")
    m.base("q_age", q, f"avg(CASE WHEN status = 'QUOTED' THEN datediff(DATE'{as_of}', full_date) END)")
    for name, condition in {"p": "true", "p_force": "status = 'ACTIVE'", "p_expired": "status = 'EXPIRED'", "p_soon": f"status = 'ACTIVE' AND end_date <= date_add(DATE'{as_of}', 30)"}.items():
        m.base(name, p, f"count_if({condition})")
    m.base("p_active", p, f"count_if({active_policies})")
    m.base("p_customers", p, "count(DISTINCT CASE WHEN status = 'ACTIVE' THEN customer_key END)")
    m.base("premium", p, "sum(premium_amount)")
    m.base("premium_earned", p, "sum(CASE WHEN status IN ('ACTIVE', 'EXPIRED') THEN premium_amount END)")
    m.base("p_start", p, "min(start_date)")
    m.base("pay", pay, "count(*)")
    m.base("pay_total", pay, "sum(payment_amount)")
    for s in ("PAID", "PENDING", "FAILED"):
        m.base(f"pay_{s.lower()}", pay, f"count_if(status = '{s}')")
        m.base(f"amount_{s.lower()}", pay, f"sum(CASE WHEN status = '{s}' THEN payment_amount END)")
    m.base("pay_days", pay, "avg(CASE WHEN status = 'PAID' AND payment_amount > 0 THEN datediff(full_date, issued_date) END)")
    for i, (_, first, last) in enumerate(AGING):
        age = f"datediff(DATE'{as_of}', full_date)"
        limits = " AND ".join([f"{age} >= {first}"] * (first is not None) + [f"{age} <= {last}"] * (last is not None))
        m.base(f"aging_{i}", pay, f"sum(CASE WHEN status = 'PENDING' AND {limits} THEN payment_amount END)")
    m.base("can", can, "count(*)")
    m.base("refund", can, "sum(refund_amount)")


def _sales(m: Model, percent: float) -> None:
    """Quotation and policy measures; ``percent``: the scale of the conversion rate."""
    m.measure("Total Quotations", "q", same)
    m.measure("Accepted Quotations", "q_won", same)
    m.measure("Policies Issued", "p", or_zero)
    m.measure("Conversion Rate", "q_converted q", ratio(0.0, percent))
    m.measure("Total Written Premium (VND)", "premium", same)
    m.measure("Collected Premium Revenue", "amount_paid", same)
    m.measure("Avg Written Premium per Policy (VND)", "premium p", ratio(0.0))
    m.measure("Active Customers", "p_customers", same)
    m.measure("Policies In Force", "p_force", same)
    m.measure("Funnel Drop-off: Issued to In Force", "p p_force", lambda p, f: p - f)


def _operations(m: Model, failed: float, blank: bool) -> None:
    """Payment and cancellation measures; ``failed``: the scale of the failed rate; ``blank``: whether sums without rows are blank."""
    total = same if blank else or_zero
    m.measure("Active Policies", "p_active", same)
    m.measure("Cancelled Policies", "can", total)
    m.measure("Payment Collection Rate", "pay_paid pay", ratio(0.0))
    m.measure("Total Written Premium", "premium_earned", total)
    m.measure("Total Collected Premium", "amount_paid", total)
    m.measure("Pending Payments (VND)", "amount_pending", same)
    m.measure("Failed Payment Rate", "pay_failed pay", ratio(0.0, failed))
    m.measure("Monthly Collected Amount", "amount_paid", same)
    m.measure("Monthly Pending Amount", "amount_pending", same)
    m.measure("Monthly Failed Amount", "amount_failed", same)
    m.measure("Monthly Policies Issued", "p", same)
    m.measure("Monthly Cancellations", "can", same)
    for i, (name, _, _) in enumerate(AGING):
        m.measure(f"Pending Aging {name}", f"aging_{i}", total)
    m.measure("Payment Collection Rate by Provider", "pay_paid pay", ratio(0.0))
    m.measure("Average Payment Time (Days)", "pay_days", same)
    m.measure("Policy Cancellation Rate", "can p", lambda c, p: divide(or_zero(c), or_zero(p), 0.0))
    m.measure("Policies Expiring Soon", "p_soon", same)
    m.measure("Refund Amount", "refund", same)
    m.measure("Refund Rate", "refund amount_paid", lambda r, c: divide(or_zero(r), or_zero(r) + or_zero(c), 0.0) * 100)


def dashboard_one(facts: dict[str, DataFrame], as_of: str) -> Model:
    """Policies count by their issue date. Active policies end on the report's day or later."""
    m = Model(facts)
    _bases(m, as_of, f"status = 'ACTIVE' AND end_date >= DATE'{as_of}'")
    _sales(m, 1.0)
    _operations(m, 100.0, blank=True)
    m.measure("Rejected + Expired Rate by Month", "q_lost q", ratio(0.0))
    m.measure("Rejected Quotations", "q_rejected", same)
    m.measure("Expired Quotations", "q_expired", same)
    m.measure("Rejected Quotations (Ops View)", "q_rejected", same)
    m.measure("Quote-to-Accept Rate", "q_won q", ratio(0.0))
    m.measure("Acceptance Rate", "q_won q", ratio(0.0, 100.0))
    m.measure("Sub Acceptance Rate", "q_won q", lambda n, d: F.concat(F.format_string("%.1f", divide(n, d, 0.0) * 100), F.lit("% Acceptance Rate")))
    m.measure("Policies Issued Rate", "p q", ratio(0.0, 100.0))
    m.measure("Quotation Age (day)", "q_age", same)
    m.measure("Lost Deal Analysis", "q_lost", same)
    m.measure("Active Agents", "q_agents", same)
    # named in the documents only
    m.measure("In Force Rate", "p_force q", ratio(0.0, 100.0))
    m.base("q_won_premium", "fact_quotation", f"sum(CASE WHEN {WON} THEN premium_amount END)")
    m.measure("NTU Gap (VND)", "q_won_premium premium", lambda a, b: or_zero(a) - or_zero(b))
    return m


def dashboard_two(facts: dict[str, DataFrame], as_of: str) -> Model:
    """Policies count by their end date; give ``fact_policy`` in that role. Active policies go by status alone."""
    m = Model(facts)
    _bases(m, as_of, "status = 'ACTIVE'")
    _sales(m, 100.0)
    _operations(m, 1.0, blank=False)
    m.measure("Expired Policies", "p_expired", same)
    m.measure("Successful Payment Rate", "pay_paid pay", ratio(None))
    m.measure("Avg Payment Value", "pay_total pay", ratio(None))
    m.measure("Total Pending Premium", "amount_pending", same)
    m.measure("Total Failed Premium", "amount_failed", same)
    m.measure("Policy Start Date", "p_start", same)
    m.measure("Avg Premium per Policy", "premium p", ratio(None))
    m.measure("Total Amount", "pay_total", or_zero)
    m.measure("Total payment", "pay", same)
    return m


def growth(m: Model, measure: str, by: list[str] | None = None, where: str | None = None, otherwise: float | None = None, difference: bool = False, column: str = "value") -> DataFrame:
    """year_number, the fields ``by``, the measure as ``column``, the year before's as prior, and growth."""
    fields = ["year_number", *(by or [])]
    df = m.evaluate([measure], fields, where)
    return year_over_year(df.toDF(*fields, column), "year_number", column, by or [], otherwise, difference)


#: Measures that have a month-to-date form, and its name.
TO_DATE = {"Total Quotations": "Quotation Count by Month", "Policies Issued": "Policies Issued by Month", "Conversion Rate": "Conversion Rate by Month", "Total Written Premium (VND)": "Written Premium by Month"}
#: Measures of the year before.
LAST_YEAR = {"Total Quotations": "Quotations PY", "Total Written Premium (VND)": "Premium PY", "Conversion Rate": "Conversion Rate PY"}
#: Growth cards, what they are of, and whether they change in points.
GROWTH = {
    "Quotation Growth % YoY": ("Total Quotations", False), "Accepted Quotations Growth % YoY": ("Accepted Quotations", False), "Policies Issued Growth % YoY": ("Policies Issued", False),
    "Policies In Force Growth % YoY": ("Policies In Force", False), "Active Customer Growth % YoY": ("Active Customers", False), "Premium Growth % YoY": ("Total Written Premium (VND)", False),
    "Avg Premium Change % YoY": ("Avg Written Premium per Policy (VND)", False), "Conversion Rate Change YoY": ("Conversion Rate", True),
}
#: Growth labels of dashboard two: their value's name, what they are of, and whether they change in points.
GROWTH_TWO = {
    "Growth Policies Issued %": ("Growth Policies Issued % Value", "Policies Issued", False), "Growth Total Written Premium %": ("Growth Total Written Premium Value %", "Total Written Premium (VND)", False),
    "Growth Total Collected Premium %": ("Growth Total Collected Premium Value %", "Total Collected Premium", False), "Growth Expired Policies %": ("Growth Expired Policies Value %", "Expired Policies", False),
    "Growth Active Policies %": ("Growth Active Policies Value %", "Active Policies", False), "Growth Avg Premium per Policy %": ("Growth Avg Premium per Policy Value %", "Avg Premium per Policy", False),
    "Growth Total Payment Amount %": ("Growth Total Payment Amount Value", "Total Amount", False), "Growth Avg Payment Value %": ("Growth Avg Payment Value", "Avg Payment Value", False),
    "Growth Policies Expiring Soon %": ("Growth Policies Expiring Soon Value %", "Policies Expiring Soon", False), "Growth Payment Collection Rate %": ("Growth Payment Collection Rate Value %", "Payment Collection Rate", True),
    "Growth Successful Payment Rate %": ("Growth Successful Payment Rate Value", "Successful Payment Rate", True), "Growth Failed Payment Rate %": ("Growth Failed Payment Rate Value", "Failed Payment Rate", True),
    "Growth Policy Cancellation Rate %": ("Growth Policy Cancellation Rate Value %", "Policy Cancellation Rate", True),
}
#: Fields of the agent and the provider dimension.
AGENT, PROVIDER, STATUS = ("agent_id", "agent_name", "region"), ("provider_code",), ("status",)


def _is_new(prior: Column) -> Column:
    return F.coalesce(prior.cast("double"), F.lit(0.0)) == 0


def _off(now: Column, prior: Column, points: bool) -> Column:
    off = F.coalesce(now.cast("double"), F.lit(0.0)) - prior.cast("double")
    return off if points else F.when(~_is_new(prior), off / prior.cast("double"))


def _label(now: Column, prior: Column, points: bool) -> Column:
    """New without a year before, or with one of zero; else an arrow and the change."""
    x = _off(now, prior, points)
    arrow = F.when(x > 0, "▲ ").when(x < 0, "▼ ").otherwise("▬ ")
    return F.when(_is_new(prior), F.lit("🆕 New")).otherwise(F.concat(arrow, F.format_string("%.1f", x * 100), F.lit("pts vs PY" if points else "% vs PY")))


def expressions(m: Model) -> dict[str, Expr]:
    """Every measure of a model by name, with those that change the filter context: shares, benchmarks, best members, other years and the month
    to date. Where the facts lack a field that one needs, evaluating it is an error."""
    out: dict[str, Expr] = {n: of(m, n) for n in m.measures}
    share = lambda e, fields, times=1.0: Op(lambda n, d: divide(n, d, 0.0) * times, (e, Remove(e, fields)))
    conversion, issued, quoted = out["Conversion Rate"], out["Policies Issued"], out["Total Quotations"]
    out["Volume Share by Provider"] = share(quoted, PROVIDER, 100.0)
    out["Policies Issued by Agent"] = Remove(issued, ("agent_name", "region"))
    out["Conv Rate by Region"] = Remove(conversion, ("agent_id", "agent_name"))
    out["Agent vs Regional Benchmark"] = conversion - out["Conv Rate by Region"]
    out["Benchmark Color"] = Op(lambda x: F.when(x < 0, "#FF6666").otherwise("#32CD32"), (out["Agent vs Regional Benchmark"],))
    out["Top Agent Name (Policies)"] = Each(issued, "agent_name", "last")
    out["Top Agent Policies Count"] = Each(issued, "agent_name", "top")
    out["Best Conv Rate Agent Name"] = Each(conversion, "agent_name", "last")
    out["Average Conversion Rate (Agent)"] = Each(conversion, "agent_id", "mean")
    for name, status in {"Lost Deals by City": "status IN ('REJECTED', 'EXPIRED')", "Rejected by City": "status = 'REJECTED'", "Expired by City": "status = 'EXPIRED'"}.items():
        out[name] = Where(quoted, status)
    out["Policy Status Distribution"] = share(issued, STATUS)
    active = out["Active Policies"]
    out["% Change Active vs Prior Year"] = Op(lambda n, p: divide(n - p, p, 0.0), (active, Prior(active)))
    for name, later in TO_DATE.items():
        out[later] = ToDate(out[name])
    for name, before in LAST_YEAR.items():
        out[before] = Prior(out[name])
    premium = out["Total Written Premium (VND)"]
    out["YoY Premium Growth %"] = Op(lambda n, p: divide(n - p, p, 0.0) * 100, (premium, Prior(premium)))
    out["PY Label"] = Op(lambda y: F.concat(F.lit("PY ("), (y - 1).cast("string"), F.lit(")")), (Remove(Leaf("fact_quotation", "max(year_number)"), ("full_date", "year_number", "month_number", "year_month")),))
    for name, (what, points) in GROWTH.items():
        off = (lambda n, p: n - p) if points else (lambda n, p: divide(n - p, p))
        out[name] = Op(off, (out[what], Prior(out[what])))
        out[f"{name} Display"] = Op(lambda g, unit=" pts" if points else "%": arrow_label(F.round(g, 6), unit), (out[name],))
        out[f"{name} Color"] = Op(sign_color, (out[name],))
    for name, (value, what, points) in GROWTH_TWO.items():
        if what in out:
            pair = (out[what], Prior(out[what]))
            out[value] = Op(lambda n, p, points=points: F.when(~_is_new(p), F.round(_off(n, p, points), 6)), pair)
            out[name] = Op(lambda n, p, points=points: _label(n, p, points), pair)
    out["Growth Policies Issued Icon"] = Op(lambda n, p: F.when(_is_new(p) | (_off(n, p, False) >= 0), "▲").otherwise("▼"), (issued, Prior(issued)))
    out["NA Label"] = Op(lambda n: F.when(n.isNotNull() | n.isNull(), "N/A"), (issued,))
    known = f"{PROVIDER[0]} <> 'UNKNOWN'"
    out["Top Premium Provider"] = Where(Each(out["Total Written Premium"], PROVIDER[0], "last"), known)
    out["Best Collection Rate Provider"] = Each(out["Payment Collection Rate by Provider"], PROVIDER[0], "names")
    out["Highest Cancel Rate Provider"] = Where(Each(out["Policy Cancellation Rate"], PROVIDER[0], "last"), known)
    out["Active Providers"] = Leaf("fact_policy", "count(DISTINCT provider_code)")
    out["Pending Aging Amount"] = Leaf("fact_payment", "sum(CASE WHEN status = 'PENDING' THEN payment_amount END)")
    if "fact_policy@end" in m.facts:
        out["Policies Issued (End Date)"] = Role(issued, "fact_policy", "end")
    return out
