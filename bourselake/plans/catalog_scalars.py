"""Scalar rules (family C) over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bourselake.functions import dates, labels, provenance
from bourselake.functions import numbers as num
from bourselake.plans.catalog import query
from bourselake.plans.oracle import VIEWS, allows, fx, tier

_PLAIN = "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"

# Number cells as pages and files write them: plain, grouped, padded, percent, undisclosed and unreadable.
VIEWS["cells"] = (
    (),
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount,
         CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN CAST(l_extendedprice AS VARCHAR) WHEN 1 THEN '-' WHEN 2 THEN ' N/A ' WHEN 3 THEN '' WHEN 4 THEN 'abc'
           WHEN 5 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',' || '250.75' WHEN 6 THEN '  ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ' ELSE '"' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.5%"' END AS cell
       FROM lineitem""",
)


def cells(m):
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    q = F.col("l_quantity").cast("long").cast("string")
    cell = (
        F.when(k == 0, F.col("l_extendedprice").cast("string")).when(k == 1, "-").when(k == 2, " N/A ").when(k == 3, "").when(k == 4, "abc")
        .when(k == 5, F.concat(q, F.lit(",250.75"))).when(k == 6, F.concat(F.lit("  "), q, F.lit(" "))).otherwise(F.concat(F.lit('"'), q, F.lit('.5%"')))
    )
    return m.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", cell.alias("cell"))


_NUM = f"CASE WHEN regexp_matches(trim(replace(cell, ',', '')), {_PLAIN}) THEN TRY_CAST(trim(replace(cell, ',', '')) AS DOUBLE) END"
KEY = ("l_orderkey", "l_linenumber")


@query("c1_num_or_null", "cells", f"SELECT l_orderkey, l_linenumber, cell, {_NUM} AS value FROM cells")
def _(m):
    return cells(m).select(*KEY, "cell", num.num_or_null(F.col("cell")).alias("value"))


@query("c2_positive_or_null", "cells", f"SELECT l_orderkey, l_linenumber, CASE WHEN v > 0 THEN v END AS value FROM (SELECT *, {_NUM} - 100.0::DOUBLE AS v FROM cells)")
def _(m):
    return cells(m).select(*KEY, num.positive_or_null(num.num_or_null(F.col("cell")) - 100.0).alias("value"))


@query("c3_derive_or_null", "priced", "SELECT symbol, date, close - ycp AS change FROM priced")
def _(m):
    return m.prices.select("symbol", "date", num.derive_or_null(F.col("close"), F.col("ycp"), lambda c, y: c - y).alias("change"))


@query("c4_sum_term", "cells", f"SELECT l_suppkey, {fx('t')} AS total FROM (SELECT l_suppkey, sum(coalesce({_NUM}, 0)) AS t FROM cells GROUP BY l_suppkey)")
def _(m):
    return cells(m).groupBy("l_suppkey").agg(num.to_fixed(F.sum(num.sum_term(num.num_or_null(F.col("cell"))))).alias("total"))


@query("c5_to_fixed", "", f"SELECT l_orderkey, l_linenumber, {fx('x')} AS two, {fx('x', 4)} AS four FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount / l_quantity AS x FROM lineitem)")
def _(m):
    x = F.col("l_extendedprice") * F.col("l_discount") / F.col("l_quantity")
    return m.table("lineitem").select(*KEY, num.to_fixed(x).alias("two"), num.to_fixed(x, 4).alias("four"))


VIEWS["day_texts"] = (
    (),
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 2 THEN '"' || strftime(o_orderdate, '%b %-d, %Y') || '"'
         WHEN 3 THEN ' ' || strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:00' END AS t FROM orders""",
)


def day_texts(m):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate").cast("date")
    f = lambda p: F.date_format(d, p)
    t = (
        F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("MMM d, yyyy")).when(k == 2, F.concat(F.lit('"'), f("MMM d, yyyy"), F.lit('"')))
        .when(k == 3, F.concat(F.lit(" "), f("yyyy/MM/dd"))).when(k == 4, "soon").otherwise(F.concat(f("yyyy-MM-dd"), F.lit("T10:00")))
    )
    return m.table("orders").select("o_orderkey", d.alias("d"), t.alias("t"))


@query("c6_normalize_date", "day_texts", "SELECT o_orderkey, t, CASE WHEN o_orderkey % 6 < 4 THEN d END AS date FROM day_texts")
def _(m):
    return day_texts(m).select("o_orderkey", "t", dates.normalize_date(F.col("t")).alias("date"))


@query(
    "c7_clean_num", "cells",
    """SELECT l_orderkey, l_linenumber, CASE WHEN cell IN ('', '-', 'N/A') THEN NULL ELSE TRY_CAST(nullif(regexp_extract(regexp_replace(cell, '[",\\s%]', '', 'g'), '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE) END AS value FROM cells""",
)
def _(m):
    return cells(m).select(*KEY, num.clean_num(F.col("cell")).alias("value"))


VIEWS["codes"] = (("roster",), "SELECT key, CASE key % 7 WHEN 0 THEN ' amcl ' WHEN 1 THEN 'KAYQUE' WHEN 2 THEN 'npolymar' ELSE lower(symbol) || ' ' END AS raw FROM roster")


@query("c8_symbol_alias", "codes", "SELECT key, upper(trim(raw)) AS clean, CASE upper(trim(raw)) WHEN 'AMCL' THEN 'AMCL(PRAN)' WHEN 'KAYQUE' THEN 'KAY&QUE' WHEN 'NPOLYMAR' THEN 'NPOLYMER' ELSE upper(trim(raw)) END AS symbol FROM codes")
def _(m):
    k = F.col("key") % 7
    raw = F.when(k == 0, " amcl ").when(k == 1, "KAYQUE").when(k == 2, "npolymar").otherwise(F.concat(F.lower("symbol"), F.lit(" ")))
    clean = provenance.clean_symbol(raw)
    return m.roster.select("key", clean.alias("clean"), provenance.resolve_alias(clean).alias("symbol"))


@query("c9_tier_of", "bars", f"SELECT symbol, date, source, {tier('source')} AS tier, {tier('source')} IS NOT NULL AS approved FROM bars")
def _(m):
    s = F.col("source")
    return m.bars.select("symbol", "date", "source", provenance.tier_of(s).alias("tier"), provenance.is_approved(s).alias("approved"))


@query("c10_tier_allows_overwrite", "prices_existing prices_incoming", f"SELECT e.symbol, e.date, seq, {allows('e.source', 'i.source')} AS allowed FROM prices_existing e JOIN prices_incoming i USING (symbol, date)")
def _(m):
    e = m.prices_existing.select("symbol", "date", F.col("source").alias("old"))
    j = m.prices_incoming.select("symbol", "date", "seq", "source").join(e, ["symbol", "date"])
    return j.select("symbol", "date", "seq", provenance.tier_allows_overwrite(F.col("old"), F.col("source")).alias("allowed"))


@query("c11_tier_display_name", "market_index", f"SELECT date, source, CASE {tier('source')} WHEN 1 THEN 'Tier 1' WHEN 2 THEN 'Tier Two' END AS label FROM market_index")
def _(m):
    return m.index.select("date", "source", provenance.tier_display_name(F.col("source")).alias("label"))


@query("c12_value_changed", "fundamentals fundamentals_incoming", "SELECT symbol, fiscal_year, a.eps_basic IS DISTINCT FROM b.eps_basic AS eps_changed, a.oci_mn IS DISTINCT FROM b.oci_mn AS oci_changed FROM fundamentals a JOIN fundamentals_incoming b USING (symbol, fiscal_year)")
def _(m):
    a = m.fundamentals.select("symbol", "fiscal_year", F.col("eps_basic").alias("e"), F.col("oci_mn").alias("o"))
    j = a.join(m.fundamentals_incoming.select("symbol", "fiscal_year", "eps_basic", "oci_mn"), ["symbol", "fiscal_year"])
    return j.select("symbol", "fiscal_year", num.value_changed(F.col("e"), F.col("eps_basic")).alias("eps_changed"), num.value_changed(F.col("o"), F.col("oci_mn")).alias("oci_changed"))


@query(
    "c13_fixed_income_class", "roster",
    """SELECT key, CASE WHEN hit THEN 'Fixed Income' ELSE ac END AS asset_class, CASE WHEN NOT hit THEN sec WHEN s LIKE 'TB%' THEN 'Govt Treasury Bond' WHEN s LIKE '%SUKUK%' THEN 'Sukuk' WHEN s LIKE '%DEB%' THEN 'Debenture' ELSE 'Corporate Bond' END AS sector,
         CASE WHEN NOT hit THEN category WHEN s LIKE 'TB%' THEN 'Govt Bond' WHEN s LIKE '%SUKUK%' THEN 'Sukuk' ELSE 'Bond' END AS category FROM (
         SELECT *, (s LIKE 'TB%' OR s LIKE '%BOND%' OR s LIKE '%SUKUK%' OR s LIKE '%DEB%') AND (sec IS NULL OR ac IS NOT DISTINCT FROM 'Fixed Income') AS hit FROM (
           SELECT key, category, CASE key % 6 WHEN 0 THEN 'TB10Y' || key WHEN 1 THEN 'ASUKUK' || key WHEN 2 THEN 'XDEB' || key WHEN 3 THEN 'YBOND' || key ELSE symbol END AS s,
             CASE WHEN key % 4 <> 0 THEN NULL ELSE sector END AS sec, CASE WHEN key % 8 = 0 THEN 'Fixed Income' END AS ac FROM roster))""",
)
def _(m):
    k, ks = F.col("key"), F.col("key").cast("string")
    s = F.when(k % 6 == 0, F.concat(F.lit("TB10Y"), ks)).when(k % 6 == 1, F.concat(F.lit("ASUKUK"), ks)).when(k % 6 == 2, F.concat(F.lit("XDEB"), ks)).when(k % 6 == 3, F.concat(F.lit("YBOND"), ks)).otherwise(F.col("symbol"))
    cls = labels.fixed_income_class(s, F.when(k % 4 == 0, F.col("sector")), F.when(k % 8 == 0, F.lit("Fixed Income")), F.col("category"))
    return m.roster.select("key", cls.alias("c")).select("key", "c.*")


@query("c14_change_and_pct", "prices", "SELECT symbol, date, change, change_percent FROM prices")
def _(m):
    c, y = F.col("close"), F.col("ycp")
    return m.prices.select("symbol", "date", num.change_abs(c, y).alias("change"), num.change_pct(c, y).alias("change_percent"))


@query("c15_well_formed_days", "day_texts", "SELECT o_orderkey, t FROM day_texts WHERE t NOT LIKE '%T%' AND t NOT LIKE '%:%'")
def _(m):
    return day_texts(m).filter(dates.well_formed_day(F.col("t"))).select("o_orderkey", "t")


@query(
    "c16_labels", "bars",
    """SELECT symbol, date, CASE WHEN value_mn < 1 THEN 'Illiquid' WHEN value_mn < 10 THEN 'Moderate' ELSE 'Liquid' END AS liquidity, CASE WHEN volume <= 25 THEN 'Deep Historical Discount (<25th Percentile)'
         WHEN volume <= 75 THEN 'Fair Historical Range (25th–75th Percentile)' ELSE 'Elevated Multiple (>75th Percentile)' END AS corridor FROM bars""",
)
def _(m):
    return m.bars.select("symbol", "date", labels.liquidity_class(F.col("value_mn")).alias("liquidity"), labels.valuation_status(F.col("volume")).alias("corridor"))


@query("c17_audited_period", "fundamentals", "SELECT symbol, fiscal_year, 'FY' || fiscal_year || CASE WHEN key % 3 = 0 THEN '' ELSE ' Annual' END AS label FROM fundamentals")
def _(m):
    period = F.when(F.col("key") % 3 != 0, F.col("period"))
    return m.fundamentals.select("symbol", "fiscal_year", labels.audited_period(F.col("fiscal_year"), period).alias("label"))


@query(
    "c18_date_math", "",
    """SELECT o_orderkey, DATE '2001-12-31' - d AS days, CASE WHEN month(d) = 2 AND day(d) = 29 AND day(CAST(d - to_years(3) AS DATE)) = 28 THEN CAST(d - to_years(3) AS DATE) + 1 ELSE CAST(d - to_years(3) AS DATE) END AS three_years_before
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def _(m):
    d = F.col("o_orderdate").cast("date")
    return m.table("orders").select("o_orderkey", dates.days_between(F.lit("2001-12-31").cast("date"), d).alias("days"), dates.add_years(d, -3).alias("three_years_before"))


@query("c19_total_bonus_hours", "promos", "SELECT code, coalesce(bonus_days, 0) * 24 + coalesce(bonus_hours, 0) AS hours FROM promos")
def _(m):
    return m.promos.select("code", labels.total_bonus_hours(F.col("bonus_days"), F.col("bonus_hours")).alias("hours"))
