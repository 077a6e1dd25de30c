"""Market tables derived by Spark from the given star-schema tables.

Every mart is a lazy DataFrame. Sums run over whole cents and whole lots, so results do not depend on the order of
addition. One symbol is one supplier, one session is one (symbol, day): the first aggregation has map-side partial sums,
so a supplier with a third of all lines costs one row per day after it, and per-symbol windows are bounded by the calendar.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourselake.functions import numbers as num
from bourselake.operators import ratios as ratio_ops
from bourselake.operators import sets
from bourselake.session import folder_bytes, freed_shuffles, shared_folder

NUM = "double"
#: Stored bytes of lineitem whose symbols are worked on at once; the disk that their shuffles take goes by this and not by the table.
SLICE_BYTES = 128 << 20


def symbol_of(key: Column) -> Column:
    """Ten digits, so codes stay distinct for up to ten billion keys."""
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 10, "0"))


def cents(amount: Column) -> Column:
    return F.rint(amount * 100).cast("long")


def daily_bars(lines: DataFrame) -> DataFrame:
    """One bar per supplier and ship day: exact value and volume sums, unit-price range, volume-weighted close."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    bars = lines.groupBy(F.col("l_suppkey").alias("key"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.sum(cents(F.col("l_extendedprice"))).alias("value_cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )
    value = F.col("value_cents").cast(NUM)
    return bars.select(
        symbol_of(F.col("key")).alias("symbol"),
        "key",
        "date",
        F.lit(None).cast(NUM).alias("open"),
        "high",
        "low",
        (value / 100.0 / F.col("volume").cast(NUM)).alias("close"),
        "volume",
        (value / 1e8).alias("value_mn"),
        "trades",
        "value_cents",
        F.when(F.col("key") % 3 == 0, "DSE_SCRAPE").when(F.col("key") % 3 == 1, "LANKABD").otherwise("UNKNOWN").alias("source"),
    )


class Marts:
    """The logical tables of one data directory."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its file schema is looked up once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._tables[name]

    def settle(self, *names: str) -> Marts:
        """These tables computed once, for queries that read them in several places: Parquet in the folder that the cluster shares.

        What derives from a settled table reads it too, so tables are named from the ground up.
        """
        for name in names:
            rows, path = getattr(self, name), f"{shared_folder(self.spark)}/mart-{name}-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            self.__dict__[name] = self.spark.read.schema(rows.schema).parquet(path)
        return self

    @cached_property
    def slice_count(self) -> int:
        """In how many slices of symbols large tables derived from lineitem are worked on."""
        return max(1, ceil(folder_bytes(self.spark, f"{self.path}/lineitem.parquet") / SLICE_BYTES))

    def by_symbol(self, make: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
        """``make(part)``, which looks at one symbol at a time, over slices of symbols; ``part`` gives the slice of a table.

        Results of several slices are kept as Parquet in the folder that the cluster shares, and the shuffle files of a slice go when
        it is written. The tables are read once for each slice.
        """
        n = self.slice_count
        if n == 1:
            return make(lambda rows: rows)
        path = f"{shared_folder(self.spark)}/slices-{uuid.uuid4().hex}"
        for i in range(n):
            rows = make(lambda table, i=i: sets.slices(table, n, "symbol")[i])
            with freed_shuffles(self.spark):
                rows.write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # -- prices ---------------------------------------------------------------------------------------------------

    @cached_property
    def bars(self) -> DataFrame:
        return daily_bars(self.table("lineitem"))

    @cached_property
    def prices(self) -> DataFrame:
        ycp = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
        return self.bars.withColumn("ycp", ycp).select(
            "symbol", "key", "date", "open", "high", "low", "close", "ycp",
            num.change_abs(F.col("close"), F.col("ycp")).alias("change"),
            num.change_pct(F.col("close"), F.col("ycp")).alias("change_percent"),
            "volume", "value_mn", "trades",
            F.lit(None).cast(NUM).alias("pe"),
            F.lit(None).cast(NUM).alias("market_cap_mn"),
            "source", "value_cents",
        )

    @cached_property
    def as_of(self):
        """Latest session day; one aggregate over one column."""
        return self.table("lineitem").agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]

    @cached_property
    def prices_dirty(self) -> DataFrame:
        """Prices with zero closes on some 13ths and repeated records on every 17th."""
        p = self.prices
        zero = (F.col("key") % 5 == 0) & (F.dayofmonth("date") == 13)
        repeats = F.when(F.dayofmonth("date") == 17, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return (
            p.withColumn("close", F.when(zero, F.lit(0.0)).otherwise(F.col("close")))
            .withColumn("pe", F.col("close") / 100.0)
            .withColumn("seq", F.explode(repeats))
        )

    @cached_property
    def prices_existing(self) -> DataFrame:
        return daily_bars(self.table("lineitem").filter(F.col("l_linestatus") == "O"))

    @cached_property
    def prices_incoming(self) -> DataFrame:
        """A second source: other lines, tier by year; on every 17th a corrected record follows in the same batch."""
        b = daily_bars(self.table("lineitem").filter(F.col("l_returnflag") != "N"))
        src = F.when(F.year("date") % 2 == 0, "LANKABD").otherwise("DSE_SCRAPE")
        repeats = F.when(F.dayofmonth("date") == 17, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        late = F.col("seq") == 2
        return (
            b.withColumn("source", src)
            .withColumn("seq", F.explode(repeats))
            .withColumn("close", F.when(late, F.col("close") + 1.0).otherwise(F.col("close")))
            .withColumn("high", F.when(late, F.lit(None)).otherwise(F.col("high")))
        )

    # -- index ----------------------------------------------------------------------------------------------------

    def _index(self, prices: DataFrame) -> DataFrame:
        close, ycp = F.col("close"), F.col("ycp")
        src = (
            F.when(F.dayofmonth("date") % 4 == 0, "DSE_OFFICIAL_ARCHIVE")
            .when(F.dayofmonth("date") % 4 == 1, "DSE_OFFICIAL_BENCHMARK")
            .when(F.dayofmonth("date") % 4 == 2, "DSE_OFFICIAL_GRAPH")
            .otherwise("LANKABD")
        )
        return (
            prices.groupBy("date")
            .agg(
                F.sum("value_cents").alias("vc"),
                F.sum("volume").alias("total_volume"),
                F.count_if(close > ycp).alias("advancing"),
                F.count_if(close < ycp).alias("declining"),
                F.count_if(close == ycp).alias("unchanged"),
                F.sum("trades").alias("total_trades"),
            )
            .select(
                "date",
                (F.col("vc").cast(NUM) / 100.0 / F.col("total_volume").cast(NUM)).alias("index_value"),
                "advancing", "declining", "unchanged", "total_trades", "total_volume",
                (F.col("vc").cast(NUM) / 1e8).alias("total_value_mn"),
                src.alias("source"),
            )
        )

    @cached_property
    def index(self) -> DataFrame:
        """Market-wide volume-weighted price per day; at most one row per calendar day."""
        return self._index(self.prices)

    @cached_property
    def ds30(self) -> DataFrame:
        """The same over every fourth symbol, with the previous level."""
        d = self._index(self.prices.filter(F.col("key") % 4 == 0)).select("date", F.col("index_value").alias("ds30_index"), "source")
        return d.withColumn("prev_close", F.lag("ds30_index").over(W.partitionBy(F.lit(1)).orderBy("date")))

    # -- statements -----------------------------------------------------------------------------------------------

    @cached_property
    def fundamentals(self) -> DataFrame:
        li = self.table("lineitem")
        ext, qty = cents(F.col("l_extendedprice")), F.col("l_quantity").cast("long")
        disc = F.rint(F.col("l_discount") * 100).cast("long")
        tax = F.rint(F.col("l_tax") * 100).cast("long")
        s = li.groupBy(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("fiscal_year")).agg(
            F.sum(ext).alias("ext"),
            F.sum(ext * (100 - disc)).alias("gross"),
            F.sum(ext * (100 - disc - tax)).alias("oper"),
            F.sum(F.when(F.col("l_returnflag") == "R", -2 * ext).otherwise(ext)).alias("net"),
            F.sum(disc * qty).alias("dq"),
            F.sum(qty).alias("q"),
        )
        sup = self.table("supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal")
        k, y = F.col("key"), F.col("fiscal_year")
        mn = lambda c, scale: (F.col(c).cast(NUM) / scale).alias
        f = s.join(sup, "key", "left").select(
            "key", "fiscal_year", "dq", "q",
            mn("ext", 1e8)("revenue_mn"), mn("gross", 1e10)("gross_profit_mn"), mn("oper", 1e10)("operating_profit_mn"), mn("net", 1e8)("net_income_mn"),
            num.positive_or_null(F.col("s_acctbal")).alias("paid_up_capital_mn"),
        )
        f = f.withColumns(
            {
                "total_assets_mn": F.col("revenue_mn") * 3.0,
                "total_liabilities_mn": F.col("gross_profit_mn") * 2.0,
                "eps_basic": F.col("net_income_mn") * 20.0,
            }
        )
        dps = (
            F.when((k + y) % 5 == 0, F.lit(None))
            .when(k % 4 == 0, (y - 1990).cast(NUM) * 0.5)
            .otherwise(F.floor(F.col("dq").cast(NUM) * 10.0 / F.col("q").cast(NUM)).cast(NUM) / 10.0)
        )
        null = F.lit(None).cast(NUM)
        return f.select(
            symbol_of(k).alias("symbol"), "key", "fiscal_year",
            F.lit("Annual").alias("period"),
            "eps_basic",
            F.when(k % 6 != 0, F.col("eps_basic") * 0.95).alias("eps_diluted"),
            (F.col("revenue_mn") * 50.0).alias("nav_per_share"),
            dps.alias("dps"),
            F.when(k % 5 == 1, (y % 4).cast(NUM)).alias("bonus_pct"),
            "paid_up_capital_mn",
            (F.col("paid_up_capital_mn") * 2.0).alias("authorized_capital_mn"),
            "revenue_mn", "gross_profit_mn", "operating_profit_mn", "net_income_mn",
            "total_assets_mn", "total_liabilities_mn",
            (F.col("revenue_mn") * 1.2).alias("current_assets_mn"),
            (F.col("gross_profit_mn") * 0.8).alias("current_liabilities_mn"),
            (F.col("operating_profit_mn") * 1.5).alias("reserve_surplus_mn"),
            F.when(k % 9 != 0, F.col("revenue_mn") * 0.01).alias("oci_mn"),
            (F.col("total_liabilities_mn") * 0.2).alias("short_term_loan_mn"),
            F.when(k % 10 != 3, F.col("total_liabilities_mn") * 0.3).alias("long_term_loan_mn"),
            (F.col("net_income_mn") + 1.0).alias("operating_cash_flow_mn"),
            F.lit(0.5).alias("capex_mn"),
            (F.col("net_income_mn") + 1.0 - 0.5).alias("free_cash_flow_mn"),
            null.alias("debt_to_equity"),
            null.alias("current_ratio"),
            F.lit(None).cast("string").alias("quarterly_disclosure"),
            F.when(y < 2001, "Audited").otherwise("Provisional").alias("audit_status"),
            F.when(k % 2 == 0, "DSE_OFFICIAL").otherwise("STAGING_DB").alias("source"),
        )

    @cached_property
    def statements(self) -> DataFrame:
        """Fundamentals with year-end close and the ratios derived from it."""
        return ratio_ops.derived_ratios(self.fundamentals, self.prices)

    @cached_property
    def fundamentals_incoming(self) -> DataFrame:
        """A later disclosure run: some values revised, some unchanged, one year added per symbol."""
        f = self.fundamentals
        revised = F.col("key") % 3 == 0
        same_years = (
            f.withColumn("eps_basic", F.when(revised, F.col("eps_basic") + 1.0).otherwise(F.col("eps_basic")))
            .withColumn("oci_mn", F.when(F.col("key") % 2 == 0, F.lit(None)).otherwise(F.col("oci_mn")))
            .withColumn("long_term_loan_mn", F.coalesce("long_term_loan_mn", F.col("short_term_loan_mn") * 0.5))
        )
        added = f.filter(F.col("fiscal_year") == 2000).withColumn("fiscal_year", F.lit(2050))
        return same_years.unionByName(added)

    # -- roster and holders ---------------------------------------------------------------------------------------

    @cached_property
    def roster(self) -> DataFrame:
        k = F.col("s_suppkey")
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                symbol_of(k).alias("symbol"),
                k.alias("key"),
                F.col("s_name").alias("name"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("category"),
                F.when(k % 7 != 0, F.lit(10.0)).alias("face_value"),
                F.when(k % 8 != 0, (k * 1000 + 1000000).cast(NUM)).alias("total_shares"),
                (k % 11 != 0).alias("is_active"),
                (k % 4 == 0).alias("ds30"),
                F.when(k % 11 != 0, "Active").otherwise("Delisted").alias("trading_status"),
                F.lit("DSE_SCRAPE").alias("source"),
            )
        )

    @cached_property
    def roster_incoming(self) -> DataFrame:
        """A later roster payload: some symbols gone, some in a new category, some new, unknown details left null."""
        r = self.roster.filter(F.col("key") % 6 != 5)
        moved = r.withColumn("category", F.when(F.col("key") % 5 == 2, F.concat(F.lit("NEW_"), F.col("category"))).otherwise(F.col("category"))).withColumn(
            "face_value", F.when(F.col("key") % 2 == 0, F.col("face_value"))
        )
        fresh = r.filter(F.col("key") % 6 == 1).withColumn("symbol", F.concat(F.lit("N"), F.col("symbol")))
        return moved.unionByName(fresh)

    @cached_property
    def shareholding(self) -> DataFrame:
        """Five holder shares per symbol now, and the same before 1999 as the previous disclosure."""
        li = self.table("lineitem")
        q = F.col("l_quantity").cast("long")
        flag = F.concat("l_returnflag", "l_linestatus")
        old = F.col("l_shipdate").cast("date") < F.lit("1999-01-01").cast("date")
        holders = {"sponsor": ["RO"], "govt": ["RF"], "institute": ["AF"], "foreign": ["AO"], "public": ["NO", "NF"]}
        aggs = [F.sum(q).alias("all_now"), F.sum(F.when(old, q)).alias("all_prev")]
        for h, flags in holders.items():
            aggs += [
                F.coalesce(F.sum(F.when(flag.isin(flags), q)), F.lit(0)).alias(f"{h}_now"),
                F.coalesce(F.sum(F.when(flag.isin(flags) & old, q)), F.lit(0)).alias(f"{h}_prev"),
            ]
        g = li.groupBy(F.col("l_suppkey").alias("key")).agg(*aggs)
        cols = [symbol_of(F.col("key")).alias("symbol"), "key"]
        for h in holders:
            now = F.col(f"{h}_now").cast(NUM) * 100.0 / F.col("all_now").cast(NUM)
            if h == "public":
                now = F.when(F.col("key") % 13 == 0, now + 5.0).otherwise(now)
            cols.append(now.alias(f"{h}_pct"))
        has_prev = (F.col("key") % 10 != 9) & F.col("all_prev").isNotNull()
        for h in holders:
            prev = F.col(f"{h}_prev").cast(NUM) * 100.0 / F.col("all_prev").cast(NUM)
            cols.append(F.when(has_prev, prev).alias(f"prev_{h}_pct"))
        cols += [
            F.lit("2001-12-31").cast("date").alias("as_of_date"),
            F.when(has_prev, F.lit("1998-12-31").cast("date")).alias("prev_as_of_date"),
        ]
        return g.select(*cols)

    @cached_property
    def block_trades(self) -> DataFrame:
        b = daily_bars(self.table("lineitem").filter(F.col("l_quantity") >= 45))
        return b.select(
            "symbol", "key", "date",
            F.col("volume").alias("quantity"), "value_mn", "trades",
            F.col("low").alias("min_price"), F.col("high").alias("max_price"),
            F.lit("LANKABD").alias("source"),
        )

    @cached_property
    def corporate_actions(self) -> DataFrame:
        f = self.fundamentals.filter(F.col("dps").isNotNull())
        day = F.make_date(F.col("fiscal_year") + 1, F.lit(3), F.lit(31))
        return f.select(
            "symbol", "key",
            F.lit("DIVIDEND").alias("event_type"),
            day.alias("event_date"),
            F.date_add(day, 10).alias("record_date"),
            F.lit(None).cast("date").alias("agm_date"),
            F.col("dps").alias("cash_dps"),
            "bonus_pct",
            "fiscal_year",
            F.when(F.col("key") % 2 == 0, "LANKABD").otherwise("DSE_OFFICIAL").alias("source"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        """Agency ratings: one per symbol and order year of the supplier's first line that year."""
        f = self.fundamentals
        day = F.make_date(F.col("fiscal_year"), F.lit(5), F.lit(15))
        return f.select(
            "symbol", "key",
            F.when(F.col("key") % 3 == 0, F.lit(None)).otherwise("CRAB").alias("rating_agency"),
            F.when(F.col("eps_basic") > 20, "AAA").when(F.col("eps_basic") > 0, "A").otherwise("BB").alias("long_term_rating"),
            F.when(F.col("key") % 2 == 0, "ST-1").alias("short_term_rating"),
            F.when(F.col("eps_basic") < 0, "Negative").alias("outlook"),
            day.alias("rating_date"),
            F.when(F.col("key") % 7 == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 364)).alias("valid_until"),
            F.lit(None).cast("string").alias("rating_action"),
            F.lit("DSE_OFFICIAL").alias("source"),
        )

    @cached_property
    def lockins(self) -> DataFrame:
        """Share lock-ins: volume of a symbol per return flag, released a year after its last session."""
        g = self.table("lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("flag")).agg(
            F.sum(F.col("l_quantity").cast("long")).alias("q"), F.max(F.col("l_shipdate").cast("date")).alias("last_day")
        )
        return g.select(
            symbol_of(F.col("key")).alias("symbol"), "key",
            F.when(F.col("flag") == "A", F.lit(None)).otherwise(F.concat(F.lit("Lock-in "), F.col("flag"))).alias("lockin_category"),
            F.when((F.col("key") % 9 == 0) & (F.col("flag") == "R"), F.lit(0)).otherwise(F.col("q")).cast("long").alias("quantity"),
            F.date_add("last_day", 365).alias("release_date"),
            F.lit("DSE_OFFICIAL").alias("source"),
        )

    # -- accounts -------------------------------------------------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("user_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"),
            F.date_add(F.lit("1992-01-01").cast("date"), (k % 3650).cast("int")).alias("created_at"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        plan = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "WEEKLY")
            .when(F.col("o_orderpriority") == "2-HIGH", "MONTHLY")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "QUARTERLY")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "HALF_YEARLY")
            .otherwise("LIFETIME")
        )
        price = (
            F.when(plan == "WEEKLY", 100).when(plan == "MONTHLY", 300).when(plan == "QUARTERLY", 700)
            .when(plan == "HALF_YEARLY", 1000).otherwise(5000)
        )
        status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
        return self.table("orders").select(
            F.col("o_orderkey").alias("txn"),
            F.col("o_custkey").alias("user_id"),
            plan.alias("plan"),
            (price + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("amount_bdt"),
            status.alias("status"),
            F.col("o_orderdate").cast("date").alias("created_at"),
        )

    @cached_property
    def redemptions(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("id")
        )

    @cached_property
    def promos(self) -> DataFrame:
        """Codes seen in the redemption log plus their bonus; the last character of a code drives the numbers."""
        codes = self.redemptions.select("code").distinct()
        n = F.substring("code", 1, 1).try_cast("int")
        spare = codes.select(F.concat(F.lit("UNUSED-"), F.col("code")).alias("code"))
        return codes.unionByName(spare).select(
            "code",
            F.when(F.substring("code", 1, 1) == "U", 1).otherwise(n % 3).cast("int").alias("bonus_days"),
            F.when(F.substring("code", 1, 1) == "U", F.lit(None)).otherwise(F.when(n == 3, 0).otherwise(n * 2)).cast("int").alias("bonus_hours"),
            (~F.col("code").isin("5-LOW")).alias("active"),
        )

    @cached_property
    def watchlist(self) -> DataFrame:
        """Symbols a customer's orders touch, with the first order day as the day added."""
        o = self.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("added_at"))
        li = self.table("lineitem").select("l_orderkey", "l_suppkey")
        return (
            o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_custkey").alias("user_id"), symbol_of(F.col("l_suppkey")).alias("symbol"))
            .agg(F.min("added_at").alias("added_at"))
        )

    # -- ticks ----------------------------------------------------------------------------------------------------

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            symbol_of(F.col("user_id")).alias("symbol"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ltp")
        )

    @cached_property
    def tick_base(self) -> DataFrame:
        """First tick of a symbol as yesterday's close."""
        return self.ticks.groupBy("symbol").agg(F.min_by("ltp", F.struct("ts", "event_id")).alias("ycp"))
