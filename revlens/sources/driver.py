"""The benchmark driver's tables seen as raw CRM tables.

The driver ships TPC-H-like tables plus an ``events`` stream, not CRM data.
Each raw CRM table below is a deterministic projection of one of them (the
same mapping is written in SQL in ``plans.oracle``); every staged table is a
staging pipeline applied to a raw one.  The mapping has what real CRM data
has: text keys, repeated leads, several opportunities per lead, repeated
opportunity ids with another amount, several sales per opportunity, repeated
order ids, repeated ABM rows, missing channels, contacts and outcomes, mixed
date layouts, and values that convert to nothing.

Dates move: events are all January 2024 and orders 1995-2001, so order dates
are folded into 2024-01-01 + (days since 1995-01-01) mod 90.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators import staging as stg
from revlens.sources.catalog import Catalog

# Fixed values of the adapter (chosen here, mirrored in plans.oracle).
CRM_BASE_DAY = _dt.date(2024, 1, 1)
ORDER_ORIGIN_DAY = _dt.date(1995, 1, 1)
CRM_DAY_SPAN = 90
UTM_MEDIUMS = ["cpc", "social", "referral", None]            # by k mod 4
EMPLOYEE_BUCKETS = ["1-10", "11-50", "51-200", "201+"]     # by c_custkey mod 4
PLANS = ["Basic ", " Pro", "Enterprise"]                   # by c_nationkey mod 3
TARGET_REASONS = [" High Value ", "Expansion fit"]         # by s_suppkey mod 2
SPEND_CHANNELS = ["email", "organic", "paid", "sales"]     # by p_partkey mod 4
TOO_LARGE = 1e12                                           # beyond DECIMAL(10,2)

# Declared schemas of the driver tables: no inference job per read.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}
DRIVER_TABLES = tuple(DRIVER_SCHEMAS)


def crm_day(c: Column) -> Column:
    """Order date folded into the three CRM months."""
    days = F.datediff(c.cast("date"), F.lit(ORDER_ORIGIN_DAY)) % CRM_DAY_SPAN
    return F.date_add(F.lit(CRM_BASE_DAY), days.cast("int"))


def _pick(values: list, idx: Column) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def _event_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def _key(prefix: str, c: Column) -> Column:
    """Text keys such as CON42."""
    return F.concat(F.lit(prefix), c.cast("string"))


def _every(n: int, c: Column, then: Column, otherwise: Column) -> Column:
    return F.when(c % n == 0, then).otherwise(otherwise)


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _copies(df: DataFrame, twice: Column) -> DataFrame:
    """Every row with copy = 0, and again with copy = 1 where ``twice`` holds."""
    return df.select("*", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _utm(k: Column, event_id: Column) -> dict[str, Column]:
    medium = _pick(UTM_MEDIUMS, k % 4)
    return {"utm_medium": _every(6, event_id, F.concat(F.lit(" "), F.upper(medium), F.lit(" ")), medium),
            "utm_campaign": F.concat(F.lit("cmp_"), (k % 10).cast("string"))}


# ---- events -> touch source tables ----------------------------------------
def web_sessions_from_events(events: DataFrame) -> DataFrame:
    """Raw web sessions: view and click events."""
    e = events.where(F.col("event_type").isin("view", "click"))
    k = _event_k(e.props)
    return e.select(
        _every(97, e.event_id, _nothing("string"), _key("CON", e.user_id)).alias("contact_id"), e.ts.alias("started_at"),
        _every(19, e.event_id, _nothing("string"), F.when(e.event_type == "view", "organic").otherwise("paid")).alias("channel"),
        F.when(k >= 80, _nothing("string")).otherwise(_key("CMP", k)).alias("campaign_id"),
        F.lit("web").alias("utm_source"), *[v.alias(n) for n, v in _utm(k, e.event_id).items()],
        e.event_id.cast("string").alias("touch_id"))


def email_from_events(events: DataFrame) -> DataFrame:
    """Raw email engagement: signup events; sent_at is text, now and then no date."""
    e = events.where(F.col("event_type") == "signup")
    k = _event_k(e.props)
    return e.select(_key("CON", e.user_id).alias("contact_id"),
                    _every(53, e.event_id, F.lit("unknown"), F.date_format(e.ts, "yyyy-MM-dd")).alias("sent_at"),
                    F.lit("email").alias("utm_source"),
                    *[v.alias(n) for n, v in _utm(k, e.event_id).items()], e.event_id.cast("string").alias("touch_id"))


def activities_from_events(events: DataFrame) -> DataFrame:
    """Raw sales activities: purchase (connected, or no outcome) and error (no_answer) events."""
    e = events.where(F.col("event_type").isin("purchase", "error"))
    done = _every(29, e.event_id, _nothing("string"), F.lit("connected"))
    return e.select(_key("ACT", e.event_id).alias("activity_id"), _key("CON", e.user_id).alias("contact_id"), e.ts,
                    e.event_type.alias("type"),
                    F.when(e.event_type == "error", "no_answer").otherwise(done).alias("outcome"))


def load(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalog of raw and staged CRM tables over ``sf_dir``."""
    cat = Catalog(spark)
    for t in DRIVER_TABLES:
        cat.read_parquet(f"driver.{t}", f"{sf_dir.rstrip('/')}/{t}.parquet", DRIVER_SCHEMAS[t])
    d = lambda name: cat[f"driver.{name}"]

    # ---- orders: leads, opportunities, sales, contacts --------------------
    def leads():
        o = _copies(d("orders"), F.col("o_orderkey") % 5 == 0)
        key, day, again = o.o_orderkey, crm_day(o.o_orderdate), o.copy == 1
        hour = F.when(again, F.when(key % 10 == 0, 5).otherwise(11)).otherwise(8)
        answered = F.timestamp_add("HOUR", hour, day.cast("timestamp_ntz")).cast("timestamp_ntz")
        return o.select(
            _key("LED", key).alias("lead_id"),
            _every(101, key, _nothing("string"), _key("CON", o.o_custkey)).alias("contact_id"),
            F.when(again, F.lit("import")).otherwise(o.o_orderpriority).alias("source"),
            _every(211, key, F.lit("n/a"), F.date_format(day, "yyyy-MM-dd")).alias("created_at"),
            F.when((key % 7 == 0) & ~again, _nothing("timestamp_ntz")).otherwise(answered).alias("first_response_at"),
            (o.o_orderstatus != "O").cast("int").alias("mql_flag"),
            (o.o_orderstatus == "F").cast("int").alias("sql_flag"))

    def opportunities():
        o = _copies(d("orders").where(F.col("o_orderstatus").isin("F", "P")), F.col("o_orderkey") % 17 == 0)
        key, day = o.o_orderkey, crm_day(o.o_orderdate)
        return o.select(
            _key("OPP", key).alias("opportunity_id"),
            _every(37, key, _key("GONE", key), _key("LED", F.when(key % 4 == 1, key - 1).otherwise(key))).alias("lead_id"),
            o.o_orderstatus.alias("stage"), (o.o_totalprice.cast("decimal(10,2)") + o.copy).cast("decimal(10,2)").alias("amount"),
            day.cast("timestamp_ntz").alias("created_at"),
            _every(59, key, F.lit("pending"), F.date_format(F.date_add(day, 14), "MM/dd/yyyy")).alias("close_date"),
            (o.o_orderstatus == "F").cast("int").alias("win_flag"))

    def sales():
        key = F.col("o_orderkey")
        o = _copies(d("orders").where(F.col("o_orderstatus") == "F"), (key % 11 == 0) | (key % 13 == 0))
        own = _key("ORD", o.o_orderkey)
        return o.select(
            F.when((o.copy == 1) & (o.o_orderkey % 11 == 0), F.concat(own, F.lit("-2"))).otherwise(own).alias("order_id"),
            _key("OPP", o.o_orderkey).alias("opportunity_id"),
            (o.o_totalprice.cast("decimal(10,2)") + 10 * o.copy).cast("decimal(10,2)").alias("booked_amount"),
            F.date_add(crm_day(o.o_orderdate), 3 * o.copy).cast("timestamp_ntz").alias("booked_at"))

    def crm_contacts():
        o = d("orders")
        n, key = o.o_custkey.cast("string"), o.o_orderkey
        email = (F.when(key % 11 == 0, _nothing("string"))
                  .when(key % 7 == 0, F.concat(F.lit(" User"), n, F.lit(" [at] Example.COM ")))
                  .when(key % 5 == 0, F.concat(F.lit("user"), n, F.lit("@example.org")))
                  .otherwise(F.concat(F.lit("User"), n, F.lit("@example.com"))))
        day = crm_day(o.o_orderdate)
        created = (F.when(key % 29 == 0, F.lit("2024-13-45"))
                    .when(key % 3 == 0, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")))
        return o.select(_key("CON", o.o_custkey).alias("contact_id"), email.alias("email"),
                        created.alias("created_at"), o.o_orderpriority.alias("lead_source"),
                        key.alias("rid"))

    # ---- lineitem: subscriptions -------------------------------------------
    def subscriptions():
        li = d("lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag", "l_discount")
        o = d("orders").select("o_orderkey", "o_custkey")
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        churned = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
        return j.select(_key("ACC", F.col("o_custkey")).alias("account_id"),
                        F.col("l_extendedprice").cast("decimal(10,2)").alias("mrr"),
                        F.when(churned, "churned").otherwise("active").alias("status"))

    def content_engagement():
        e = d("events")
        return e.select(_key("CNT", e.event_id).alias("content_id"), _key("CON", e.user_id).alias("contact_id"),
                        _every(61, e.event_id, F.lit("yesterday"), e.ts.cast("string")).alias("engaged_at"))

    # ---- customer / supplier / part: accounts, ABM, spend, SEO -----------
    def accounts():
        c, n, r = d("customer"), d("nation"), d("region")
        j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
        return j.select(
            _key("ACC", c.c_custkey).alias("account_id"),
            F.replace(c.c_name, F.lit("#"), F.lit(" ")).alias("account_name"),
            F.concat(F.lit("  "), c.c_mktsegment, F.lit(" ")).alias("industry"),
            _pick(EMPLOYEE_BUCKETS, c.c_custkey % 4).alias("employee_bucket"),
            F.col("r_name").alias("region"), _every(47, c.c_custkey, F.lit(TOO_LARGE), c.c_acctbal).alias("current_mrr"),
            _pick(PLANS, c.c_nationkey % 3).alias("plan"))

    def abm_accounts():
        s = _copies(d("supplier"), F.col("s_suppkey") % 9 == 0)
        return s.select(
            _key("ACC", s.s_suppkey).alias("account_id"),
            _pick(TARGET_REASONS, s.s_suppkey % 2).alias("target_reason"),
            F.concat(F.lit("tier_"), ((s.s_suppkey + s.copy) % 3 + 1).cast("string")).alias("abm_tier"))

    def spend():
        p = d("part")
        return p.select(
            F.make_date(F.lit(2024), (p.p_size % 3 + 1).cast("int"), F.lit(1)).alias("month_start"),
            _pick(SPEND_CHANNELS, p.p_partkey % 4).alias("channel"),
            F.when(p.p_partkey % 31 == 0, F.lit("n/a")).when(p.p_partkey % 37 == 0, F.lit("123456789012.50"))
             .otherwise(p.p_retailprice.cast("decimal(10,2)").cast("string")).alias("spend"))

    def seo_search_console():
        p = d("part")
        return p.select(_key("PAGE", p.p_partkey).alias("page_key"),
                        _every(43, p.p_partkey, F.lit(TOO_LARGE), p.p_retailprice / 7).alias("avg_position"))

    raw = {
        "crm_contacts": crm_contacts, "leads": leads, "opportunities": opportunities, "sales": sales,
        "web_sessions": lambda: web_sessions_from_events(d("events")),
        "email_engagement": lambda: email_from_events(d("events")),
        "sales_activities": lambda: activities_from_events(d("events")),
        "content_engagement": content_engagement, "accounts": accounts, "abm_accounts": abm_accounts,
        "spend": spend, "seo_search_console": seo_search_console, "subscriptions": subscriptions,
        "assets": lambda: d("part"), "campaigns": lambda: d("supplier"), "web_pageviews": lambda: d("pages"),
    }
    for name, f in raw.items():
        cat.register(name, f)
    stg.register_staged(cat, raw)
    return cat
