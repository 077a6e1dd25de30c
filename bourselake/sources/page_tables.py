"""Records out of tables in raw web pages (``page_id, url, html``). Every step is a built-in expression.

A page is one row; its records are exploded inside the task that reads it, so parsing needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import numbers as num
from bourselake.functions.dates import ISO_DAY, day

# Patterns of table rows, cells and the data embedded in pages.
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
YEAR = r"^(19|20)\d{2}$"
SERIES = r'"(\d{4}-\d{2}-\d{2}),([\d.]+)\\n"'
HOLDER_DAY = r"(?i)Share Holding Percentage\s*\[as on ([^\]]+?)(?:\s*\(year ended\))?\]"


def text_of(html: Column) -> Column:
    """Visible text: tags dropped, common entities decoded, white space collapsed. Plain cells skip all of it."""
    t = F.regexp_replace(html, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(html.rlike(r"[<&\s]"), t).otherwise(html)


def cells_of(row: Column) -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(CELL), F.lit(1)), text_of)


def table_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per table row: the kept page columns, its position and its cells."""
    rows = F.posexplode(F.regexp_extract_all("html", F.lit(ROW), F.lit(1))).alias("pos", "row")
    return pages.select(*keep, rows).select(*keep, "pos", cells_of(F.col("row")).alias("cells"))


def cell(i: int) -> Column:
    """Cell at a zero-based position, null past the end."""
    return F.get("cells", F.lit(i))


def n(i: int) -> Column:
    return num.num_or_null(cell(i))


def whole(i: int) -> Column:
    return F.floor(num.leading_number(cell(i)))


def extract_day_end(pages: DataFrame) -> DataFrame:
    """Daily archive rows: number, day, code, last, high, low, open, close, previous close, trades, value, volume."""
    r = table_rows(pages).filter((F.size("cells") >= 12) & cell(1).rlike(ISO_DAY))
    r = r.select(
        F.upper(cell(2)).alias("symbol"), day(cell(1)).alias("date"), n(6).alias("open"), n(4).alias("high"), n(5).alias("low"),
        F.coalesce(n(7), n(3)).alias("close"), n(8).alias("ycp"), n(9).alias("trades"), n(10).alias("value_mn"), n(11).alias("volume"), F.lit("DSE_SCRAPE").alias("source"),
    )
    return r.filter(F.col("close") > 0)


def extract_closing(pages: DataFrame) -> DataFrame:
    """Closing-price rows; change only from a real previous close, and no opening price because the page has none."""
    p = lambda i: num.leading_number(cell(i))
    r = table_rows(pages).filter(F.size("cells") >= 4).select(
        F.upper(cell(1)).alias("symbol"), p(2).alias("close"), num.positive_or_null(p(3)).alias("ycp"), F.lit(None).cast("double").alias("open"),
        p(4).alias("high"), p(5).alias("low"), whole(6).alias("volume"), p(7).alias("value_mn"),
    )
    change = num.change_abs(F.col("close"), F.col("ycp"))
    pct = F.when(F.col("ycp") > 0, num.to_fixed(F.col("change") / F.col("ycp") * 100.0))
    return r.filter((F.col("symbol") != "") & (F.col("close") > 0)).withColumn("change", change).withColumn("change_percent", pct)


def extract_breadth(pages: DataFrame) -> DataFrame:
    """Index level and breadth of a summary page: a row of labels is followed by the row of its values."""
    pieces = F.split("html", r'<div class="midrow')
    segments = F.slice(pieces, 2, F.size(pieces))
    texts = F.transform(segments, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"(?is)<div[^>]*>([^<]*)</div>"), F.lit(1)), text_of))
    pairs = F.transform(F.col("t"), lambda x, i: F.struct(x.alias("labels"), F.get("t", i + 1).alias("values")))
    p = pages.select("page_id", texts.alias("t")).select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.*")
    joined = F.lower(F.concat_ws("|", "labels"))
    moves, totals = joined.contains("advanced"), joined.contains("total trade")
    level = F.get("labels", F.lit(0)).rlike(r"(?i)^DSEX\s+Index$")
    at = lambda c, i: num.num_or_null(F.get(c, F.lit(i)))
    pick = lambda cond, v: F.max(F.when(cond, v))
    return p.groupBy("page_id").agg(
        pick(level, at("labels", 1)).alias("index_value"), pick(moves, at("values", 0)).alias("advancing"), pick(moves, at("values", 1)).alias("declining"),
        pick(moves, at("values", 2)).alias("unchanged"), pick(totals, at("values", 0)).alias("total_trades"), pick(totals, at("values", 1)).alias("total_volume"),
        pick(totals, at("values", 2)).alias("total_value_mn"),
    )


# Cell positions of the second source's archive table.
ARCHIVE_CELLS = {
    "date": 0, "high": 3, "low": 4, "open": 5, "close": 6, "ycp": 7, "trades": 13, "value_mn": 14, "volume": 15, "mcap_bn": 23,
}


def extract_archive(pages: DataFrame, at: dict[str, int] | None = None) -> DataFrame:
    """Archive rows of the second source (16 or more cells, ``yyyy/mm/dd``); market value from billions to millions."""
    pos = at or ARCHIVE_CELLS
    d = F.regexp_extract(cell(pos["date"]), r"(\d{4}/\d{2}/\d{2})", 1)
    r = table_rows(pages, "symbol").filter((F.size("cells") >= 16) & (d != "")).select(
        "symbol", day(d, "yyyy/MM/dd").alias("date"), *[n(pos[c]).alias(c) for c in ("open", "high", "low", "close", "ycp", "volume", "value_mn", "trades")],
        num.to_fixed(n(pos["mcap_bn"]) * 1000.0).alias("market_cap_mn"), F.lit("LANKABD").alias("source"),
    )
    close, ycp = F.col("close"), F.col("ycp")
    return r.filter(close > 0).withColumn("change", num.change_abs(close, ycp)).withColumn("change_percent", num.change_pct(close, ycp))


def extract_embedded_series(pages: DataFrame, floor: float = 1000.0) -> DataFrame:
    """Day and level pairs inside a chart script; zero placeholders fall away."""
    days = F.regexp_extract_all("html", F.lit(SERIES), F.lit(1))
    values = F.regexp_extract_all("html", F.lit(SERIES), F.lit(2))
    pairs = F.explode(F.arrays_zip(days.alias("d"), values.alias("v")))
    p = pages.select(pairs.alias("p")).select(day(F.col("p.d")).alias("date"), num.num_or_null(F.col("p.v")).alias("index_value"))
    return p.filter(F.col("index_value") > floor)


def _label_values(pages: DataFrame, *keep: str) -> DataFrame:
    """Every adjacent pair of cells of every table row as (label, value)."""
    r = table_rows(pages, *keep)
    pair = lambda x, i: F.struct(F.lower(x).alias("label"), F.get("cells", i + 1).alias("value"))
    return r.select(*keep, "pos", F.posexplode(F.transform("cells", pair)).alias("i", "p")).select(*keep, "pos", "i", "p.*").filter(F.col("value") != "")


def extract_company_details(pages: DataFrame) -> DataFrame:
    """Name, sector, category letter, face value and share count of a company page; the last matching pair counts."""
    p = _label_values(pages, "symbol")
    where = F.struct("pos", "i")
    last = lambda cond, v: F.max_by(v, F.when(cond, where))
    label, value = F.col("label"), F.col("value")
    is_cat = (label != "sector") & label.contains("category")
    face = ~is_cat & (label.contains("face value") | label.contains("par value"))
    shares = ~is_cat & ~face & (label.contains("total share") | label.contains("outstanding securities"))
    g = p.groupBy("symbol").agg(
        last(label == "sector", value).alias("sector"), last(is_cat, F.upper(F.substring(value, 1, 1))).alias("category"),
        last(face, num.num_or_null(value)).alias("face_value"), last(shares, num.num_or_null(value)).alias("total_shares"),
    )
    heading = F.regexp_extract("html", r"(?is)<h2[^>]*>\s*Company Name:\s*(.*?)</h2>", 1)
    names = pages.select("symbol", F.nullif(text_of(heading), F.lit("")).alias("name"))
    return names.join(g, "symbol", "left")


def last_in_group(cells: Column, start: int) -> Column:
    """Last number in three cells (original, restated, diluted), so a restated value replaces the original."""
    numbers = F.filter(F.transform(F.slice(cells, start + 1, 3), num.leading_number), lambda x: x.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))


def headline_or_continuing(cells: Column) -> Column:
    return F.coalesce(last_in_group(cells, 0), last_in_group(cells, 3))


def dividend_cell(text: Column) -> Column:
    """struct(cash_pct, bonus_pct) of a cell like '5.00, 5% B'."""
    cash = num.num_or_null(F.replace(F.get(F.split(text, ","), F.lit(0)), F.lit("%"), F.lit("")))
    bonus = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*%\s*B\b", 1)
    return F.struct(cash.alias("cash_pct"), F.when(bonus != "", bonus.try_cast("double")).alias("bonus_pct"))


def extract_yearly_statement(pages: DataFrame) -> DataFrame:
    """Two year-by-year tables of a company page: earnings and net assets, then P/E, dividend and yield.

    The tables are told apart by their captions, so a row is read with the layout of its own table.
    """
    tables = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1)))
    t = pages.select("symbol", tables.alias("html"))
    body = F.col("html")
    is_eps = body.contains("NAV Per Share") & body.contains("Earnings per share")
    is_pe = body.contains("Price Earnings (P/E) ratio") & body.contains("Dividend Yield in %")
    t = t.withColumn("kind", F.when(is_eps, "eps").when(is_pe, "pe")).filter(F.col("kind").isNotNull())
    rows = table_rows(t, "symbol", "kind").filter(cell(0).rlike(YEAR))
    rest = F.slice("cells", 2, F.size("cells"))
    r = rows.select("symbol", "kind", cell(0).try_cast("int").alias("fiscal_year"), rest.alias("d"))
    d, eps, pe = F.col("d"), F.col("kind") == "eps", F.col("kind") == "pe"
    one = lambda cond, v: F.max(F.when(cond, v))
    item = dividend_cell(F.get(d, F.lit(6)))
    num_at = lambda i: num.num_or_null(F.get(d, F.lit(i)))
    g = r.groupBy("symbol", "fiscal_year").agg(
        one(eps, headline_or_continuing(d)).alias("eps"), one(eps, F.coalesce(num_at(2), num_at(5))).alias("eps_diluted"), one(eps, last_in_group(d, 6)).alias("navps"),
        one(eps, F.coalesce(num_at(11), num_at(10), num_at(9))).alias("net_income_mn"), one(pe, headline_or_continuing(d)).alias("pe_ratio"),
        one(pe, item["cash_pct"]).alias("dividend_pct"), one(pe, item["bonus_pct"]).alias("bonus_pct"), one(pe, num_at(7)).alias("dividend_yield"),
    )
    return g.filter(F.col("eps").isNotNull() | F.col("navps").isNotNull())


def statement_records(yearly: DataFrame, roster: DataFrame) -> DataFrame:
    """Cash dividend per share from the percentage of face value; an unknown face value leaves it unknown."""
    j = yearly.join(roster.select("symbol", "face_value"), "symbol", "left")
    dps = num.to_fixed(F.col("dividend_pct") / 100.0 * F.col("face_value"), 4)
    roe = F.when(F.col("navps") > 0, num.to_fixed(F.col("eps") / F.col("navps") * 100.0))
    return j.select(*yearly.columns, dps.alias("dps"), roe.alias("roe"))


def dividend_history(rows: DataFrame, text: str, face_value: str, *keep: str) -> DataFrame:
    """Years of a dividend text like '10% C, 5% B 2024, 20% 2023': the kept columns, year, cash %, bonus %, amount per share.

    A part without a year belongs to the next year that follows it; 'B' marks a bonus, anything else is cash.
    """
    part = r"(?i)(\d+(?:\.\d+)?)\s*%\s*([CB]?)\s*((?:19|20)\d{2})?"
    groups = [F.regexp_extract_all(text, F.lit(part), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(a) for g, a in zip(groups, ("pct", "kind", "year"))])
    # The year of a part is the first one at or after its position in the same text.
    after = lambda i: F.get(F.filter(F.slice(F.col("p.year"), i + 1, F.size("p")), lambda y: y != ""), F.lit(0))
    dated = F.transform("p", lambda x, i: F.struct(x["pct"].alias("pct"), x["kind"].alias("kind"), after(i).alias("year")))
    e = rows.withColumn("p", zipped).withColumn("q", F.explode(dated)).filter(F.col("q.year").isNotNull())
    is_bonus = F.upper("q.kind") == "B"
    pct = F.col("q.pct").try_cast("double")
    g = e.groupBy(*keep, face_value, F.col("q.year").try_cast("int").alias("year")).agg(
        F.max(F.when(~is_bonus, pct)).alias("dividend_pct"), F.max(F.when(is_bonus, pct)).alias("bonus_pct")
    )
    return g.select(*keep, "year", "dividend_pct", "bonus_pct", num.to_fixed(F.col("dividend_pct") / 100.0 * F.col(face_value), 4).alias("dps"))


def extract_balance_sheet(pages: DataFrame) -> DataFrame:
    """Balance-sheet values and the dividend text of a company page, found by label."""
    p = _label_values(pages, "symbol")
    label, value = F.col("label"), num.num_or_null(F.col("value"))
    one = lambda cond, v: F.max_by(v, F.when(cond, F.struct("pos", "i")))
    return p.groupBy("symbol").agg(
        one(label.contains("reserve & surplus"), value).alias("reserve_surplus_mn"), one(label.contains("other comprehensive income"), value).alias("oci_mn"),
        one(label.contains("short-term loan"), value).alias("short_term_loan_mn"), one(label.contains("long-term loan"), value).alias("long_term_loan_mn"),
        one(label.contains("authorized capital"), value).alias("authorized_capital_mn"), one(label == "cash dividend", F.col("value")).alias("cash_dividend_text"),
    )


def extract_shareholding(pages: DataFrame) -> DataFrame:
    """Latest and previous holder disclosure of a company page; a disclosure counts only with all five holders."""
    block = F.explode(F.split("html", r"(?i)(?=Share Holding Percentage\s*\[as on)")).alias("b")
    b = pages.select("symbol", block).select("symbol", F.regexp_extract("b", HOLDER_DAY, 1).alias("d"), text_of(F.col("b")).alias("t")).filter(F.col("d") != "")
    pct = lambda name: F.regexp_extract("t", rf"(?i){name}:\s*(-?\d+\.?\d*)", 1).try_cast("double")
    names = {"sponsor": "Sponsor/Director", "govt": "Govt", "institute": "Institute", "foreign": "Foreign", "public": "Public"}
    b = b.select("symbol", F.coalesce(day(F.col("d"), "MMM d, yyyy"), day(F.col("d"), "MMMM d, yyyy")).alias("as_of_date"), *[pct(t).alias(f"{h}_pct") for h, t in names.items()])
    holders = [f"{h}_pct" for h in names]
    b = b.dropna(subset=["as_of_date", *holders])
    w = W.partitionBy("symbol").orderBy(F.desc("as_of_date"))
    r = b.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    now = [F.max(F.when(F.col("rn") == 1, F.col(x))).alias(x) for x in (*holders, "as_of_date")]
    old = [F.max(F.when(F.col("rn") == 2, F.col(x))).alias(f"prev_{x}") for x in (*holders, "as_of_date")]
    return r.groupBy("symbol").agg(*now, *old)


def extract_block_trades(pages: DataFrame) -> DataFrame:
    """Block trades of a session page: symbol, quantity, value, trades, highest and lowest price."""
    r = table_rows(pages, "session_date").filter(F.size("cells") >= 6)
    r = r.select(
        F.upper(cell(0)).alias("symbol"), F.col("session_date").alias("date"), num.positive_or_null(n(1)).alias("quantity"), n(2).alias("value_mn"), n(3).alias("trades"),
        n(4).alias("max_price"), n(5).alias("min_price"), F.lit("LANKABD").alias("source"),
    )
    return r.filter((F.col("symbol") != "") & (F.col("symbol") != "TOTAL") & F.col("quantity").isNotNull())


def extract_dividend_archive(pages: DataFrame) -> DataFrame:
    """Dividend events: the publish day, else the record day; rows with neither are skipped, never dated by guess."""
    d = lambda i: F.when(cell(i).rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), day(cell(i), "d-MMM-yyyy"))
    r = table_rows(pages).filter(F.size("cells") >= 10).select(
        F.upper(cell(0)).alias("symbol"), F.when(cell(2).rlike(r"^\d{4}$"), cell(2).try_cast("int")).alias("fiscal_year"), n(4).alias("cash"), n(5).alias("bonus"),
        F.coalesce(d(8), d(9)).alias("event_date"), d(9).alias("record_date"), d(10).alias("agm_date"),
    )
    ok = F.col("event_date").isNotNull() & (F.col("cash").isNotNull() | F.col("bonus").isNotNull() | F.col("record_date").isNotNull())
    named = (F.col("symbol") != "") & (F.col("symbol") != "SYMBOL") & (F.length("symbol") <= 20)
    return r.filter(ok & named).select(
        "symbol", F.lit("DIVIDEND").alias("event_type"), "event_date", "record_date", "agm_date", num.positive_or_null(F.col("cash")).alias("cash_dps"),
        num.positive_or_null(F.col("bonus")).alias("bonus_pct"), "fiscal_year", F.lit("LANKABD").alias("source"),
    )


def extract_live_snapshot(pages: DataFrame) -> DataFrame:
    """Intraday rows: every column is read on its own, a missing change comes from last price and previous close."""
    r = table_rows(pages).filter(F.size("cells") >= 8)
    change = F.coalesce(n(7), n(2) - n(6))
    r = r.select(
        F.upper(F.regexp_replace(cell(1), r"[^a-zA-Z0-9_-]", "")).alias("symbol"), n(2).alias("ltp"), n(3).alias("high"), n(4).alias("low"), n(5).alias("close"),
        n(6).alias("ycp"), change.alias("c"), F.coalesce(n(9), n(8)).alias("volume"), num.to_fixed(n(10)).alias("value_mn"),
    )
    named = (F.col("symbol") != "") & ~F.col("symbol").isin("TRADING_CODE", "CODE")
    pct = F.when(F.col("ycp") > 0, num.to_fixed(F.col("c") / F.col("ycp") * 100.0))
    return r.filter(named & (F.col("ltp") > 0)).withColumn("change", num.to_fixed(F.col("c"))).withColumn("change_percent", pct).drop("c")


def snapshot_breadth(snapshot: DataFrame) -> DataFrame:
    """Breadth of a snapshot from the sign of the change; unknown changes are not counted."""
    c = F.col("change")
    return snapshot.agg(
        F.count_if(c > 0).alias("advancing"), F.count_if(c < 0).alias("declining"), F.count_if(c == 0).alias("unchanged"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"), F.count(F.lit(1)).alias("issues"),
    )


def extract_recent_index(pages: DataFrame, floor: float = 1000.0) -> DataFrame:
    """Recent sessions (``dd-mm-yyyy``): index level in the sixth cell, turnover and volume null where unreadable or zero."""
    d = F.regexp_extract(cell(0), r"(\d{2}-\d{2}-\d{4})", 1)
    p = lambda i: num.leading_number(cell(i))
    r = table_rows(pages).filter((F.size("cells") >= 6) & (d != "")).select(
        day(d, "dd-MM-yyyy").alias("date"), p(5).alias("index_value"), F.when(p(3) != 0, p(3)).alias("turnover_mn"), F.when(p(2) != 0, p(2)).alias("total_volume"),
        F.lit("DSE_OFFICIAL_BENCHMARK").alias("source"),
    )
    return r.filter(F.col("index_value") > floor)
