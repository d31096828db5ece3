"""Dashboard pages as tables of visuals: each visual is the fields it groups by and its measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from stratal.semantic.catalog import expressions
from stratal.semantic.context import Cube
from stratal.semantic.engine import Model, Star, column_name

#: The pages' visuals, one a line: fields, a colon, measures (of one visual, in its order); a card has no field.
PAGES = {
    "geography": """
        : Rejected Quotations
        : Expired Quotations
        region: Conversion Rate
        city: Expired Quotations; Rejected Quotations
        : Lost Deal Analysis""",
    "product": """
        : Expired Quotations
        package_code: Total Quotations
        : Rejected Quotations
        provider_code: Volume Share by Provider
        : Quote-to-Accept Rate
        provider_code: Conversion Rate; Avg Written Premium per Policy (VND)""",
    "agents": """
        agent_name: Agent vs Regional Benchmark
        : Average Conversion Rate (Agent)
        : Active Agents
        agent_name: Policies Issued; Conversion Rate""",
    "overview": """
        : Accepted Quotations
        : Policies Issued
        : Policies In Force
        : Total Quotations
        : Active Customers
        : Total Quotations; Accepted Quotations; Policies Issued; Policies In Force
        : Total Written Premium (VND)
        : Conversion Rate
        : Avg Written Premium per Policy (VND)""",
    "providers": """
        : Active Providers
        year_number, month_number, provider_code: Total Written Premium
        provider_code: Payment Collection Rate
        provider_code: Policy Cancellation Rate
        provider_code: Total Written Premium (VND)
        provider_code: Total Written Premium; Payment Collection Rate; Policy Cancellation Rate""",
    "payments": """
        status: Total payment
        : Total Amount
        : Successful Payment Rate
        aging_bucket: Pending Aging Amount
        : Failed Payment Rate
        provider_code: Payment Collection Rate; Total Amount
        : Avg Payment Value""",
    "policies": """
        region: Policies Issued; Total Written Premium
        : Expired Policies
        : Avg Premium per Policy
        year_number, month_number: Policies Issued
        status: Policies Issued
        : Active Policies
        package_code: Policies Issued
        provider_code, package_code: Policies Issued
        : Policies Expiring Soon
        : Policies Issued""",
    "demo": """
        : Avg Payment Value; Avg Premium per Policy""",
    "operations": """
        : Total Written Premium (VND)
        : Policy Cancellation Rate
        : Policies Issued; Total payment; Active Policies; Cancelled Policies
        : Payment Collection Rate
        : Total Collected Premium""",
}


#: The pages' cards of text. They show one year; with several selected they are blank.
CARDS = {
    "overview": ("Avg Premium Change % YoY Display", "Premium Growth % YoY Display", "Conversion Rate Change YoY Display", "Accepted Quotations Growth % YoY Display", "Active Customer Growth % YoY Display",
                 "Quotation Growth % YoY Display", "Policies In Force Growth % YoY Display", "Policies Issued Growth % YoY Display"),
    "agents": ("Top Agent Name (Policies)", "Best Conv Rate Agent Name"),
    "providers": ("Top Premium Provider", "Best Collection Rate Provider", "Highest Cancel Rate Provider"),
    "payments": ("Growth Total Payment Amount %", "Growth Avg Payment Value %", "Growth Failed Payment Rate %", "Growth Successful Payment Rate %"),
    "policies": ("Growth Active Policies %", "Growth Policies Issued %", "Growth Expired Policies %", "Growth Policies Expiring Soon %", "Growth Avg Premium per Policy %"),
    "operations": ("Growth Total Collected Premium %", "Growth Policies Issued %", "Growth Total Written Premium %", "Growth Payment Collection Rate %", "Growth Policy Cancellation Rate %"),
    "demo": ("Growth Policies Expiring Soon %", "Growth Policy Cancellation Rate %"),
}
#: The pages' slicers.
SLICERS = {
    "geography": ("city", "year_number", "provider_code", "region"), "product": ("year_number", "provider_code", "region", "city"), "agents": ("provider_code", "year_number", "city", "region"),
    "overview": ("provider_code", "city", "region", "year_number"), "providers": ("provider_code", "region", "year_number", "status"), "payments": ("provider_code", "status", "region"),
    "policies": ("status", "year_number", "provider_code", "region"), "operations": ("provider_code", "region", "year_number", "status"), "records": ("region", "provider_code", "status", "year_number"),
}


@dataclass(frozen=True)
class Visual:
    by: tuple[str, ...]
    measures: tuple[str, ...]


def visuals(page: str) -> list[Visual]:
    out = []
    for line in PAGES[page].strip().splitlines():
        by, _, measures = line.strip().partition(":")
        out.append(Visual(tuple(x.strip() for x in by.split(",") if x.strip()), tuple(x.strip() for x in measures.split(";"))))
    return out


def slicers(selected: dict[str, list]) -> list[str]:
    """A condition for each field with something selected; each reaches the facts that have the field."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return [f"{name} IN ({', '.join(map(quoted, values))})" for name, values in selected.items() if values]


def render(model: Model, page: str, selected: dict[str, list] | None = None) -> DataFrame:
    """visual (from 1), category (the fields' values with a stroke between), measure, value, position: the numbers of a page under
    its slicers, in the order in which each visual shows its categories. Blanks are left out, as a chart does.

    All visuals of the page come from one scan of each fact.
    """
    cube, found = Cube(model, slicers(selected or {})), visuals(page)
    known = expressions(model)
    for v in found:
        for m in v.measures:
            cube.add(known[m], v.by)
    out = None
    for i, v in enumerate(found, 1):
        df = cube.frame({column_name(m): known[m] for m in v.measures}, v.by)
        category = F.concat_ws(" | ", *(F.coalesce(F.col(b).cast("string"), F.lit("")) for b in v.by)) if v.by else F.lit("")
        # dates rise; otherwise the first measure falls
        order = [F.asc_nulls_last(b) for b in v.by] if v.by[:1] == ("year_number",) else [F.desc_nulls_last(F.col(column_name(v.measures[0])).cast("double"))]
        shown = F.lit(False)
        for m in v.measures:
            shown = shown | F.col(column_name(m)).isNotNull()
        position = F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(*order, category)).alias("position")  # of a visual's categories
        pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(column_name(m)).cast("double").alias("value")) for m in v.measures))
        rows = df.where(shown).select(F.lit(i).alias("visual"), category.alias("category"), pairs.alias("pairs"), position)
        long = rows.select("visual", "category", F.explode("pairs").alias("p"), "position").select("visual", "category", "p.measure", "p.value", "position").where("value IS NOT NULL")
        out = long if out is None else out.unionByName(long)
    return out


def cards(model: Model, page: str, years: list[int], selected: dict[str, list] | None = None) -> DataFrame:
    """page, measure, text: what the cards of a page say; blank unless one year is selected. One scan of each fact."""
    cube, known, by = Cube(model, slicers((selected or {}) | {"year_number": years})), expressions(model), ("year_number",)
    for m in CARDS[page]:
        cube.add(known[m], by)
    wide = cube.frame({column_name(m): known[m] for m in CARDS[page]}, by)
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(column_name(m)).cast("string").alias("text")) for m in CARDS[page]))
    rows = wide.where(F.lit(len(years) == 1)).select(F.lit(page).alias("page"), F.explode(pairs).alias("p"))
    return rows.select("page", "p.measure", "p.text")


def choices(model: Model, page: str, fact: str = "fact_policy") -> DataFrame:
    """field, value: what the slicers of a page offer."""
    star = model.facts[fact]
    out = None
    for f in SLICERS[page]:
        rows = (star.with_columns({f}) if isinstance(star, Star) else star).select(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")).where("value IS NOT NULL").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def records(model: Model, selected: dict[str, list], fact: str = "fact_policy", fields: tuple[str, ...] = ("policy_id", "provider_code", "region", "status", "premium_amount")) -> DataFrame:
    """The rows behind a page: a fact's under its slicers."""
    star, where = model.facts[fact], slicers(selected)
    used = {c for w, own in model.filters(where) for c in own}
    rows = star.with_columns({*fields, *used}) if isinstance(star, Star) else star
    for w in where:
        rows = rows.where(w)
    return rows.select(*fields)
