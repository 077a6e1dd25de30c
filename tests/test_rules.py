"""Pinned values of the scalar rules and models."""

import datetime as dt
import decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bourselake.functions import dates, labels, provenance
from bourselake.functions import numbers as num
from bourselake.functions import valuation as v
from bourselake.sources import page_tables as pt
from bourselake.sources import text_lines as tl

c = F.col


@pytest.mark.parametrize(
    "text, want",
    [(None, None), ("", None), ("-", None), ("N/A", None), ("n/a", None), ("abc", None), ("0", 0.0), ("55.4", 55.4), ("1,234.56", 1234.56), ("  42  ", 42.0), ("12d", None), ("NaN", None)],
)
def test_num_or_null(one, text, want):
    assert one("t string", (text,), num.num_or_null(c("t"))) == want


def test_positive_derive_sum(one):
    assert one("x double", (0.0,), num.positive_or_null(c("x"))) is None
    assert one("x double", (-5.0,), num.positive_or_null(c("x"))) is None
    assert one("x double", (12.5,), num.positive_or_null(c("x"))) == 12.5
    minus = lambda a, b: a - b
    assert one("a double, b double", (55.4, 53.8), num.derive_or_null(c("a"), c("b"), minus)) == pytest.approx(1.6)
    assert one("a double, b double", (None, 53.8), num.derive_or_null(c("a"), c("b"), minus)) is None
    assert one("a double, b double", (55.4, None), num.derive_or_null(c("a"), c("b"), minus)) is None
    assert one("a double", (None,), num.sum_term(c("a"))) == 0
    assert one("a double", (1.23456,), num.to_fixed(c("a"))) == 1.23


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.one_of(st.floats(-1e9, 1e9), st.integers(-10**9, 10**9).map(lambda i: i / 1000)), min_size=200, max_size=400))
def test_to_fixed_is_exact(spark, xs):
    with decimal.localcontext() as ctx:
        ctx.prec = 400
        want = [float(decimal.Decimal(x).quantize(decimal.Decimal("0.01"), rounding=decimal.ROUND_HALF_UP)) for x in xs]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(num.to_fixed(c("x")).alias("y")).collect()]
    assert got == want


def test_tiers(one):
    allows = lambda a, b: one("a string, b string", (a, b), provenance.tier_allows_overwrite(c("a"), c("b")))
    assert allows("LANKABD", "DSE_SCRAPE") and not allows("DSE_SCRAPE", "LANKABD") and allows("DSE_SCRAPE", "DSE_SCRAPE")
    assert allows(None, "LANKABD") and allows("DSE_SCRAPE", None) and allows("LANKABD", "UNKNOWN_3RD_PARTY") and allows("STAGING_DB", "DSE_SCRAPE")
    tier = lambda s: one("s string", (s,), provenance.tier_of(c("s")))
    assert (tier("DSE_SCRAPE"), tier("LANKABD"), tier("KAGGLE"), tier("MCAP_WEIGHTED_ESTIMATE"), tier(None)) == (1, 2, None, None, None)
    name = lambda s: one("s string", (s,), provenance.tier_display_name(c("s")))
    assert [name(s) for s in ("STAGING_DB", "DSE_SCRAPE", "DSE_LIVE_CLOSING", "LANKABD")] == ["Tier 1", "Tier 1", "Tier 1", "Tier Two"]


def test_dates(one):
    norm = lambda t: one("t string", (t,), dates.normalize_date(c("t")))
    assert norm("2025-04-08") == dt.date(2025, 4, 8) and norm('"Jan 30, 2013"') == dt.date(2013, 1, 30) and norm("Sep 21, 2020") == dt.date(2020, 9, 21) and norm("soon") is None
    back = lambda d, n: one("d date", (d,), dates.add_years(c("d"), n))
    assert back(dt.date(2024, 2, 29), -1) == dt.date(2023, 3, 1) and back(dt.date(2024, 2, 29), -4) == dt.date(2020, 2, 29) and back(dt.date(2023, 2, 28), -3) == dt.date(2020, 2, 28)


def test_bonus_hours(one):
    hours = lambda a, b: one("a int, b int", (a, b), labels.total_bonus_hours(c("a"), c("b")))
    assert [hours(1, 6), hours(0, 6), hours(2, 0), hours(2, None)] == [30, 6, 48, 48]


def test_statement_cells(one):
    arr = "a array<string>"
    normal = ["-", "-", "-", "4.12", "-", "-", "25.60", "-", "-"]
    assert one(arr, (normal,), pt.headline_or_continuing(c("a"))) == 4.12 and one(arr, (normal,), pt.last_in_group(c("a"), 6)) == 25.6
    assert one(arr, (["9.87", "-", "-", "4.12", "-", "-"],), pt.headline_or_continuing(c("a"))) == 9.87
    assert one(arr, (["5.00", "5.25", "-"],), pt.last_in_group(c("a"), 0)) == 5.25
    assert one(arr, (["-", "-", "-"],), pt.last_in_group(c("a"), 0)) is None and one(arr, (["-"] * 6,), pt.headline_or_continuing(c("a"))) is None


def test_dividend_texts(spark, one):
    assert tuple(one("t string", ("5.00, 5% B",), pt.dividend_cell(c("t")))) == (5.0, 5.0)
    assert tuple(one("t string", ("10.00",), pt.dividend_cell(c("t")))) == (10.0, None)

    def years(text):
        df = spark.createDataFrame([("X", text, 10.0)], "symbol string, text string, face_value double")
        return {r.year: (r.dividend_pct, r.bonus_pct, r.dps) for r in pt.dividend_history(df, "text", "face_value", "symbol").collect()}

    a = years("215% 2025, 330% 2024, 300% 2023, 250% 2022")
    assert len(a) == 4 and a[2025] == (215.0, None, 21.5) and a[2024][2] == 33.0
    b = years("10% C, 5% B 2024, 20% 2023")
    assert b[2024] == (10.0, 5.0, 1.0) and b[2023][0] == 20.0


def test_balance_sheet_page(spark):
    html = """<table><tr><td class="fit">Reserve & Surplus without OCI (mn)</td><td>3,540.25</td></tr>
      <tr><td class="fit">Other Comprehensive Income (OCI) (mn)</td><td>-12.40</td></tr><tr><td>Short-term loan (mn)</td><td>850.10</td></tr>
      <tr><td>Long-term loan (mn)</td><td>1,200.00</td></tr><tr><td>Cash Dividend</td><td>215% 2025, 330% 2024, 300% 2023, 250% 2022</td></tr></table>"""
    r = pt.extract_balance_sheet(spark.createDataFrame([("X", html)], "symbol string, html string")).first()
    assert (r.reserve_surplus_mn, r.oci_mn, r.short_term_loan_mn, r.long_term_loan_mn) == (3540.25, -12.4, 850.1, 1200.0) and "215% 2025" in r.cash_dividend_text


def test_statement_lines_and_mode(spark, one):
    lines = [("Revenue from operations", "162,400.00"), ("Gross Profit for the period", "89,320.00"), ("Total Assets", "198,500.00"), ("Total Liabilities", "137,472.00"),
             ("Purchase of Property, Plant and Equipment", "18,500.00"), ("Net cash flows from operating activities", "61,200.00")]
    r = tl.statement_lines_to_columns(spark.createDataFrame([("X", *x) for x in lines], "symbol string, label string, value string"), "symbol").first()
    assert (r.revenue_mn, r.gross_profit_mn, r.free_cash_flow_mn) == (162400.0, 89320.0, 42700.0)
    mode = lambda t: one("t string", (t,), tl.content_mode(c("t")))
    assert [mode("Revenue from operations: 162,400 Total Assets: 198,500"), mode("   "), mode("random short noise")] == ["DIGITAL_VECTOR", "EMPTY", "SCANNED_IMAGE"]


# -- models -----------------------------------------------------------------------------------------------------------


def d(one, expr, **kw):
    return one(", ".join(f"{k} {'string' if isinstance(x, str) else 'double'}" for k, x in kw.items()), tuple(kw.values()), expr)


def test_intrinsic_models(one):
    g = v.graham_number(c("e"), c("n"))
    assert d(one, g, e=21.90, n=41.49) == 142.98 and d(one, g, e=-5.0, n=40.0) is None and d(one, g, e=10.0, n=0.0) is None
    lynch = v.peter_lynch(c("e"), c("g"))
    assert d(one, lynch, e=20.0, g=15.0) == 300 and d(one, lynch, e=-5.0, g=15.0) is None and d(one, lynch, e=20.0, g=80.0) == 1000
    macro = v.Macro()
    assert d(one, num.to_fixed(v.cost_of_equity(c("b"), macro) * 100.0), b=0.9) == 15.32
    ddm = lambda rf, **kw: d(one, v.ddm_value(c("dps"), c("roe"), c("po"), c("b"), v.Macro(risk_free=rf)), **kw)
    assert ddm(0.1037, dps=20.0, roe=40.0, po=0.7, b=0.9) > 0
    assert ddm(0.1037, dps=15.0, roe=22.0, po=0.3, b=1.0) > ddm(0.13, dps=15.0, roe=22.0, po=0.3, b=1.0)
    assert d(one, v.ddm_value(c("dps"), c("roe"), c("po"), c("b")), dps=None, roe=20.0, po=0.5, b=1.0) is None
    dcf = lambda rf, f, g: d(one, v.dcf_value(c("f"), c("g"), v.Macro(risk_free=rf)), f=f, g=g)
    assert dcf(0.08, 18.0, 12.0) > dcf(0.1037, 18.0, 12.0) > dcf(0.13, 18.0, 12.0) > 0
    assert dcf(0.1, -10.0, 5.0) is None and dcf(0.1, 18.0, None) is None


def test_leverage(one):
    de = v.debt_to_equity(c("s"), c("l"), c("p"), c("r"), c("o"))
    low = d(one, de, s=500.0, l=500.0, p=1000.0, r=3000.0, o=0.0)
    high = d(one, de, s=800.0, l=400.0, p=500.0, r=100.0, o=0.0)
    assert (low, high) == (0.25, 2.0) and d(one, de, s=500.0, l=500.0, p=1000.0, r=3000.0, o=None) is None
    assert d(one, v.leverage_class(c("x")), x=low) == "LOW" and d(one, v.leverage_class(c("x")), x=high) == "HIGH"


def test_ratios(one):
    assert d(one, v.price_to_sales(c("a"), c("b")), a=331500.0, b=162400.0) == 2.04 and d(one, v.price_to_sales(c("a"), c("b")), a=None, b=162400.0) is None
    pct = lambda a, b: d(one, v.percent_of(c("a"), c("b")), a=a, b=b)
    assert (pct(33075.0, 198500.0), pct(89320.0, 162400.0), pct(51968.0, 162400.0)) == (16.66, 55.0, 32.0)
    assert d(one, v.current_ratio(c("a"), c("b")), a=42150.0, b=65200.0) == 0.65 and d(one, v.working_capital(c("a"), c("b")), a=42150.0, b=65200.0) == -23050.0
    assert tuple(d(one, v.dupont(c("n"), c("r"), c("a"), c("e")), n=33075.0, r=162400.0, a=198500.0, e=61028.0)) == (20.37, 0.82, 3.25, 54.2)
    assert d(one, v.free_cash_flow(c("a"), c("b")), a=61200.0, b=18500.0) == 42700.0
    assert d(one, num.cagr_pct(c("a"), c("b"), c("y")), a=10.0, b=15.0, y=3.0) == 14.47 and d(one, num.cagr_pct(c("a"), c("b"), c("y")), a=-5.0, b=10.0, y=3.0) is None
    assert d(one, v.mean_reversion_target(c("m"), c("n")), m=2.3, n=62.0) == 142.6


def test_altman(one):
    def zone(sector, **kw):
        z = v.altman_score(*[c(k) for k in ("wc", "ta", "re", "ebit", "eq", "tl")])
        return d(one, v.altman_zone(z, F.lit(sector)), **kw)

    assert zone("Pharmaceuticals", wc=5000.0, ta=20000.0, re=8000.0, ebit=6000.0, eq=15000.0, tl=5000.0) == "SAFE"
    assert zone("Textile", wc=-10000.0, ta=15000.0, re=-8000.0, ebit=-2000.0, eq=1000.0, tl=14000.0) == "DISTRESS"
    assert zone("Bank", wc=1000.0, ta=500000.0, re=20000.0, ebit=15000.0, eq=40000.0, tl=460000.0) == "NOT_APPLICABLE"


def test_dividends_and_holders(one):
    status = lambda dps, eps: d(one, v.dividend_status(c("d"), c("e")), d=dps, e=eps)
    assert [status(15.0, 30.0), status(20.0, 15.0), status(5.0, -2.0), status(0.0, 5.0)] == ["SAFE_ORGANIC", "RESERVE_DEPLETING", "DIVIDEND_TRAP", "NO_DIVIDEND"]
    pay = lambda dps, eps: d(one, v.payout_pct(c("d"), c("e")), d=dps, e=eps)
    assert (pay(15.0, 30.0), pay(20.0, 15.0)) == (50.0, 133.3)
    pct = v.smart_money_pct(c("i"), c("f"))
    assert d(one, pct, i=45.5, f=5.0) == 50.5 and d(one, v.smart_money_status(pct, c("p")), i=45.5, f=5.0, p=9.5) == "HIGH_INSTITUTIONAL"
    assert d(one, v.smart_money_status(pct, c("p")), i=5.0, f=0.0, p=70.0) == "RETAIL_DOMINATED"


FUNDS = [
    (2021, 12.5, 2.1, 10.0, 50.0, 20.0, 5.0, 1000.0, 2000.0, 0.0, 300.0, 200.0, 800.0, 5000.0, 900.0, 2000.0, 1000.0, 6000.0, 1800.0, 700.0),
    (2022, 14.0, 2.3, 12.0, 55.0, 22.0, 6.0, 1000.0, 2500.0, 0.0, 280.0, 180.0, 1000.0, 5500.0, 1100.0, 2300.0, 1050.0, 7000.0, 2240.0, 850.0),
    (2023, 15.5, 2.5, 15.0, 62.0, 24.0, 8.0, 1000.0, 3000.0, 0.0, 260.0, 150.0, 1250.0, 6000.0, 1400.0, 2700.0, 1100.0, 8200.0, 2706.0, 1050.0),
]
FUND_COLS = (
    "fiscal_year pe_ratio pb_ratio eps_basic nav_per_share roe dps paid_up_capital_mn reserve_surplus_mn oci_mn short_term_loan_mn long_term_loan_mn "
    "net_income_mn total_assets_mn operating_cash_flow_mn current_assets_mn current_liabilities_mn revenue_mn gross_profit_mn free_cash_flow_mn"
).split()


def facts(spark, rows):
    from bourselake.operators.valuation import statement_facts

    schema = "symbol string, fiscal_year int, " + ", ".join(f"{n} double" for n in FUND_COLS[1:])
    return statement_facts(spark.createDataFrame([("X", *r) for r in rows], schema))


def test_quality_frames(spark):
    from bourselake.operators import valuation as ops

    f = facts(spark, FUNDS)
    k = ops.corridors(f).first()
    assert (k.pe_mean, k.pb_mean, k.pe_note) == (14.0, 2.3, "Calculated from last 3 years of annual data (FY2021-FY2023)")
    short = ops.corridors(facts(spark, FUNDS[:2])).first()
    assert short.pe_sample_count == 2 and "last 2 years" in short.pe_note
    p = ops.piotroski(f).first()
    assert (p.score, p.max_score, p.rating) == (9, 9, "Strong") and p.positive_roa and p.no_new_shares
    thin = [(y, *[None] * 5, dps, 1000.0, *[None] * 12) for y, dps in ((2022, 5.0), (2023, 6.0))]
    t = ops.piotroski(facts(spark, thin)).first()
    assert t.max_score == 1 and t.positive_roa is None
    m = ops.moat(f).first()
    assert (m.avg_roe, m.moat_rating) == (22.0, "Wide")


def test_decision(spark):
    from bourselake.operators.valuation import decide

    schema = (
        "symbol string, ltp double, eps_basic double, blended_target double, margin_of_safety_pct double, debt_to_equity double, zone string, moat_rating string, "
        "dividend_status string, dps double, eps_cagr double, dps_cagr double, profit_streak_years bigint, category string"
    )
    good = ("GP", 245.5, 26.5, 268.02, 8.4, 0.116, "SAFE", "Wide", "SAFE_ORGANIC", 12.5, 6.5, 5.2, 5, "A")
    bad = ("Z", 85.0, -4.5, 45.0, -88.8, 2.85, "DISTRESS", "None", "NO_DIVIDEND", 0.0, -15.0, None, 0, "Z")
    r = {x.symbol: x for x in decide(spark.createDataFrame([good, bad], schema)).collect()}
    g, z = r["GP"], r["Z"]
    assert (g.verdict, g.suggested_entry_price, g.can_buy_and_forget, g.is_storm_proof, g.is_profit_making) == ("ACCUMULATE", 219.78, True, True, True)
    assert g.projected_dividends_3y > 35 and g.projected_dividends_10y > 140 and g.projected_fair_value_5y > 300 and g.expected_annual_return_pct > 10
    assert (z.verdict, z.can_buy_and_forget, z.is_storm_proof, z.is_profit_making) == ("AVOID_DISTRESS", False, False, False) and "Category Z" in z.category_quality


def test_statuses(one):
    assert d(one, v.graham_status(c("e"), c("n")), e=-15.0, n=-20.0) == "DISTRESSED_DUAL_NEGATIVE" and d(one, v.graham_status(c("e"), c("n")), e=15.0, n=62.0) == "VIABLE"
    assert d(one, v.solvency_badge(c("q"), c("l")), q=-3000.0, l=None) == "🚨 Critical Distress / Negative Equity"
    assert d(one, v.timing_verdict(c("a"), c("z")), a="STRONG_BUY", z="OVERSOLD") == "SNIPER_BUY"
