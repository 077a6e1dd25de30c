"""Raw pages and text lines rendered by Spark from the market tables, as input of the page parsers.

A page holds a bounded slice: one symbol and year, or one day and at most 500 symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourselake.functions import numbers as num
from bourselake.plans.marts import Marts

c = F.col
SLICE = 500


def text(value: Column | str) -> Column:
    v = c(value) if isinstance(value, str) else value
    return F.coalesce(v.cast("string"), F.lit("-"))


def commas(value: str) -> Column:
    return F.coalesce(F.format_number(value, 0), F.lit("-"))


def tr(*cells: Column, tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")) for x in cells], F.lit("</tr>\n"))


def paged(rows: DataFrame, by: list[Column], order: str, head: str = "<table>", tail: str = "</table>") -> DataFrame:
    """``rows`` with a rendered ``tr`` to one page per ``by``."""
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "tr"))).alias("r"))
    body = F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["tr"]), ""), F.lit(tail))
    return g.withColumn("html", body).drop("r")


def day_end_pages(m: Marts) -> DataFrame:
    d = F.dayofmonth("date")
    shown = F.when(d == 6, F.date_format("date", "yyyy/MM/dd")).otherwise(text("date"))
    close = F.when(d == 5, "-").when(d == 7, "0").otherwise(text("close"))
    last = F.when(d == 7, "0").otherwise(text("close"))
    rows = m.prices.withColumn("tr", tr(F.lit("1"), shown, F.lower("symbol"), last, text("high"), text("low"), F.lit("N/A"), close, text("ycp"), commas("trades"), text("value_mn"), commas("volume")))
    return paged(rows, [c("symbol"), F.year("date").alias("y")], "date", "<html><body><table><tr><th>#</th><th>DATE</th></tr>", "</table></body></html>")


def closing_pages(m: Marts) -> DataFrame:
    ycp = F.when(F.dayofmonth("date") == 5, "0").otherwise(text("ycp"))
    rows = m.prices.withColumn("tr", tr(F.lit("1"), F.concat(F.lit("<a href='x'> "), F.lower("symbol"), F.lit("&nbsp;</a>")), text("close"), ycp, text("high"), text("low"), commas("volume"), text("value_mn")))
    return paged(rows, [c("date"), F.floor(c("key") / SLICE).alias("slice")], "symbol")


def breadth_pages(m: Marts) -> DataFrame:
    div = lambda cls, *xs: F.concat(F.lit(f'<div class="midrow {cls}">'), *[F.concat(F.lit('<div class="m_col">'), x, F.lit("</div>")) for x in xs], F.lit("</div>\n"))
    L = F.lit
    html = F.concat(
        div("", L("DSEX Index"), text("index_value"), L("1.0")),
        div("mt10 mol_col-wid-cus", L("Total Trade"), L("Total Volume"), L("Total Value in Taka (mn)")), div("mol_col-wid-cus", commas("total_trades"), commas("total_volume"), text("total_value_mn")),
        div("mt10 mol_col-wid-cus", L("Issues Advanced"), L("Issues Declined"), L("Issues Unchanged")), div("mol_col-wid-cus", text("advancing"), text("declining"), text("unchanged")),
    )
    return m.index.select(c("date").alias("page_id"), html.alias("html"))


def archive_pages(m: Marts) -> DataFrame:
    x = F.lit("x")
    rows = m.prices.withColumn(
        "tr",
        tr(F.date_format("date", "yyyy/MM/dd"), x, text("close"), text("high"), text("low"), F.lit("-"), text("close"), text("ycp"), x, x, x, x, x, commas("trades"), text("value_mn"), commas("volume"),
           x, x, x, x, x, x, x, F.when(c("key") % 2 == 0, text(c("trades").cast("double") / 4.0)).otherwise("-")),
    )
    return paged(rows, [c("symbol"), F.year("date").alias("y")], "date", "<table><tbody class='b'>", "</tbody></table>")


def series_pages(m: Marts) -> DataFrame:
    value = F.when(F.dayofmonth("date") == 4, "0").otherwise(text("index_value"))
    rows = m.index.withColumn("tr", F.concat(F.lit('"'), text("date"), F.lit(","), value, F.lit('\\n"+\n')))
    return paged(rows, [F.year("date").alias("y")], "date", "<script>var data = ", '"";</script>')


def company_pages(m: Marts) -> DataFrame:
    cells = lambda *xs: tr(*xs)
    L = F.lit
    html = F.concat(
        L("<h2>Company Name: <i>"), c("name"), L("</i></h2><table>"),
        cells(L("Face/par Value"), text("face_value"), L("Market Category"), F.lower("category")),
        cells(L("Total No. of Outstanding Securities"), F.coalesce(F.format_number("total_shares", 0), L("-")), L("Sector"), c("sector")), L("</table>"),
    )
    return m.roster.select("symbol", html.alias("html"))


def statement_pages(m: Marts) -> DataFrame:
    """Two tables per symbol: restated values replace originals, the headline group is empty for even keys."""
    s = m.statements
    dash = F.lit("-")
    even = c("key") % 2 == 0
    eps = num.to_fixed(c("eps_basic"), 2)
    first = [F.when(even, dash).otherwise(text(eps + 1.0)), F.when(even, dash).otherwise(text(eps)), dash]
    second = [F.when(even, text(eps)).otherwise(text(eps - 5.0)), dash, dash]
    nav = [text(num.to_fixed(c("nav_per_share"), 2)), dash, dash]
    one = tr(text("fiscal_year"), *first, *second, *nav, dash, dash, text(num.to_fixed(c("net_income_mn"), 2)), tag="td")
    cash = F.when(c("dps").isNull(), dash).when(c("bonus_pct").isNull(), F.concat(text("dps"), F.lit("%"))).otherwise(F.concat(text("dps"), F.lit(", "), text("bonus_pct"), F.lit("% B")))
    two = tr(text("fiscal_year"), dash, dash, dash, text("pe_ratio"), dash, dash, cash, text("dividend_yield"))
    g = s.select("symbol", "fiscal_year", one.alias("a"), two.alias("b")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("fiscal_year", "a", "b"))).alias("r"))
    join = lambda f: F.array_join(F.transform("r", lambda x: x[f]), "")
    html = F.concat(
        F.lit("<table class='n'><tr><th>Year</th><th>Earnings per share (EPS)</th><th>NAV Per Share</th></tr>"), join("a"), F.lit("</table>"),
        F.lit("<table><tr><th>Year</th><th>Year end Price Earnings (P/E) ratio</th><th>Dividend Yield in %</th></tr>"), join("b"), F.lit("</table>"),
    )
    return g.select("symbol", html.alias("html"))


def dividend_texts(m: Marts) -> DataFrame:
    pct = F.rint(c("dps") * 10).cast("long").cast("string")
    part = F.when(c("bonus_pct").isNull(), F.concat(pct, F.lit("% "), text("fiscal_year"))).otherwise(
        F.concat(pct, F.lit("% C, "), text("bonus_pct"), F.lit("% B "), text("fiscal_year"))
    )
    g = m.fundamentals.filter(c("dps").isNotNull()).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("fiscal_year", part.alias("t"))), asc=False).alias("r"))
    t = F.array_join(F.transform("r", lambda x: x["t"]), ", ")
    return g.select("symbol", t.alias("text")).join(m.roster.select("symbol", "face_value"), "symbol")


def balance_sheet_pages(m: Marts) -> DataFrame:
    f = m.fundamentals.groupBy("symbol").agg(
        *[F.max_by(num.to_fixed(c(x), 2), "fiscal_year").alias(x) for x in ("reserve_surplus_mn", "oci_mn", "short_term_loan_mn", "long_term_loan_mn", "authorized_capital_mn")]
    )
    L = F.lit
    money = lambda x: F.coalesce(F.format_number(x, 2), L("-"))
    html = F.concat(
        L("<table>"), tr(L("Reserve &amp; Surplus without OCI (mn)"), money("reserve_surplus_mn")), tr(L("Other Comprehensive Income (OCI) (mn)"), money("oci_mn")),
        tr(L("Short-term loan (mn)"), money("short_term_loan_mn")), tr(L("Long-term loan (mn)"), money("long_term_loan_mn")), tr(L("Authorized Capital (mn)"), money("authorized_capital_mn")),
        tr(L("Cash Dividend"), L("215% 2025, 330% 2024")), L("</table>"),
    )
    return f.select("symbol", html.alias("html"))


def holder_pages(m: Marts) -> DataFrame:
    names = {"sponsor": "Sponsor/Director", "govt": "Govt", "institute": "Institute", "foreign": "Foreign", "public": "Public"}

    def block(day: str, prefix: str) -> Column:
        cells = [F.concat(F.lit(f"<td>{t}:\n "), text(num.to_fixed(c(f"{prefix}{h}_pct"), 2)), F.lit("</td>")) for h, t in names.items()]
        return F.concat(F.lit("<tr><td>Share Holding Percentage [as on "), F.date_format(day, "MMM d, yyyy"), F.lit(" (year ended)]</td><td><table><tr>"), *cells, F.lit("</tr></table></td></tr>"))

    older = F.when(c("prev_as_of_date").isNotNull(), block("prev_as_of_date", "prev_")).otherwise("")
    return m.shareholding.select("symbol", F.concat(F.lit("<table>"), older, block("as_of_date", ""), F.lit("</table>")).alias("html"))


def block_trade_pages(m: Marts) -> DataFrame:
    qty = F.when(F.dayofmonth("date") == 3, "0").otherwise(commas("quantity"))
    rows = m.block_trades.withColumn("tr", tr(F.lower("symbol"), qty, text("value_mn"), text("trades"), text("max_price"), text("min_price")))
    total = "<tr><td>TOTAL</td><td>9</td><td>9</td><td>9</td><td>9</td><td>9</td></tr></table>"
    return paged(rows, [c("date").alias("session_date"), F.floor(c("key") / SLICE).alias("slice")], "symbol", "<table>", total)


def dividend_archive_pages(m: Marts) -> DataFrame:
    show = lambda d: F.coalesce(F.date_format(d, "d-MMM-yyyy"), F.lit("-"))
    x = F.lit("x")
    publish = F.when(c("key") % 4 == 2, F.lit("N/A")).otherwise(show("event_date"))
    record = F.when(c("key") % 8 == 2, F.lit("")).otherwise(show("record_date"))
    year = F.when(c("key") % 5 == 3, F.lit("FY?")).otherwise(text("fiscal_year"))
    rows = m.corporate_actions.withColumn("tr", tr(F.lower("symbol"), x, year, x, text("cash_dps"), text("bonus_pct"), x, x, publish, record, F.lit("-")))
    return paged(rows, [c("fiscal_year"), F.floor(c("key") / SLICE).alias("slice")], "symbol", "<table><tr><td>SYMBOL</td></tr>")


def live_pages(m: Marts) -> DataFrame:
    last = m.prices.groupBy("symbol", "key").agg(*[F.max_by(x, "date").alias(x) for x in ("close", "high", "low", "ycp", "volume", "value_mn", "change")])
    change = F.when(c("key") % 2 == 0, text("change")).otherwise("-")
    rows = last.withColumn(
        "tr", tr(F.lit("1"), F.concat(F.lit("<b>"), c("symbol"), F.lit("*</b>")), text("close"), text("high"), text("low"), text("close"), text("ycp"), change, F.lit("9"), commas("volume"), text("value_mn"))
    )
    return paged(rows, [F.floor(c("key") / SLICE).alias("slice")], "symbol")


def recent_index_pages(m: Marts) -> DataFrame:
    x = F.lit("x")
    turnover = F.when(F.dayofmonth("date") == 2, "0").otherwise(text("total_value_mn"))
    rows = m.index.withColumn("tr", tr(F.date_format("date", "dd-MM-yyyy"), x, commas("total_volume"), turnover, x, text("index_value")))
    return paged(rows, [F.year("date").alias("y")], "date")


def tick_texts(m: Marts) -> DataFrame:
    p = m.prices.filter(c("change").isNotNull())
    line = F.concat_ws(" ", F.lit("LTP:"), c("symbol"), text("close"), text("change"), F.concat(text("change_percent"), F.lit("%")), F.lit("end"))
    return p.select("date", line.alias("text"))


def prose_texts(m: Marts) -> DataFrame:
    eps, nav = num.to_fixed(c("eps_basic"), 2), num.to_fixed(c("nav_per_share"), 2)
    t = F.when(c("fiscal_year") % 2 == 0, F.concat(F.lit("Q4: Basic EPS Tk. "), text(eps), F.lit(" against last year."))).otherwise(F.concat(F.lit("As on Dec 31 NAV per share Tk. "), text(nav), F.lit(".")))
    return m.fundamentals.select("symbol", "fiscal_year", t.alias("text"))


def statement_lines(m: Marts) -> DataFrame:
    labels = {
        "revenue_mn": "Revenue from operations", "gross_profit_mn": "Gross Profit for the period", "total_assets_mn": "Total Assets", "total_liabilities_mn": "Total Liabilities",
        "capex_mn": "Purchase of Property, Plant and Equipment", "operating_cash_flow_mn": "Net cash flows from operating activities",
    }
    item = F.explode(F.array(*[F.struct(F.lit(t).alias("label"), text(num.to_fixed(c(x), 4)).alias("value")) for x, t in labels.items()]))
    return m.fundamentals.select("symbol", "fiscal_year", item.alias("i")).select("symbol", "fiscal_year", "i.*")


def price_csv_rows(m: Marts) -> DataFrame:
    """Text columns as a price CSV would give them, in two date spellings."""
    d = F.when(F.dayofmonth("date") % 2 == 0, text("date")).otherwise(F.date_format("date", "MMM d, yyyy"))
    return m.prices.select(
        F.concat(F.lit(" "), F.lower("symbol")).alias("Trading Code"), d.alias("Date"), text("open").alias("Open"), text("high").alias("High"), text("low").alias("Low"),
        F.when(F.dayofmonth("date") == 8, "0").otherwise(text("close")).alias("Close"), commas("volume").alias("Volume"),
    )


def index_csv_rows(m: Marts) -> DataFrame:
    return m.index.select(
        F.concat(F.lit('"'), F.date_format("date", "MMM d, yyyy"), F.lit('"')).alias("Date"), F.concat(F.lit('"'), text("index_value"), F.lit('"')).alias("Price"), F.lit("-").alias("Open"),
        text("index_value").alias("High"), F.lit("").alias("Low"), commas("total_volume").alias("Vol."), F.lit("1.2%").alias("Change %"),
    )
