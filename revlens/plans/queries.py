"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator.

Every query reads the driver's tables through the CRM adapter
(``sources.driver``), so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import month_start
from revlens.operators import attribution as A
from revlens.operators import bitmaps as BM
from revlens.operators import funnel as FN
from revlens.operators import influence as INF
from revlens.operators import ltv as LTV
from revlens.operators import quality as Q
from revlens.operators import repeats as R
from revlens.operators import staging as STG
from revlens.operators.collated import group_collated
from revlens.operators.dedup import keep_one
from revlens.operators.touch_index import order_path_ends, touch_index
from revlens.operators.touches import touches, touches_from
from revlens.operators.winners import WinnerTable
from revlens.plans.monthly import MonthlyMart
from revlens.session import scratch_path, written
from revlens.sources import driver
from revlens.sources.schemas import DUPLICATE_CHECKS
from revlens.sources.marts import export_report, read_back
from revlens.sources.stored import StagedStore, store_deals, stored_lead_base, stored_won_sales

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed inputs of the lookup / domain queries.
LOOKUP_CONTACT_ID = "CON42"
DOMAIN_COLUMNS = {"abm_accounts_stg": ["target_reason"], "accounts_stg": ["industry", "employee_bucket"],
                  "email_engagement_stg": ["utm_campaign"]}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _won(cat) -> DataFrame:
    return A.won_sales(cat["sales_stg"], cat["opportunities_stg"], cat["leads_stg"])


def _ctx(spark, sf_dir):
    cat = driver.load(spark, sf_dir)
    return cat, _won(cat), touches_from(cat)


# ---- touches and attribution --------------------------------------------
@query("touches")
def q_touches(spark, sf_dir):
    return touches_from(driver.load(spark, sf_dir))


@query("touches_normalized")
def q_touches_normalized(spark, sf_dir):
    """Touches with channel and UTM texts trimmed and lower-cased (N8)."""
    cat = driver.load(spark, sf_dir)
    return touches(cat["web_sessions_stg"], cat["email_engagement_stg"], cat["sales_activities_stg"],
                   normalize=True)


@query("won_sales")
def q_won_sales(spark, sf_dir):
    return _won(driver.load(spark, sf_dir))


@query("buyers")
def q_buyers(spark, sf_dir):
    cat = driver.load(spark, sf_dir)
    return A.buyers(cat["sales_stg"], cat["opportunities_stg"], cat["leads_stg"])


@query("first_lead_date")
def q_first_lead_date(spark, sf_dir):
    return A.first_lead_date(driver.load(spark, sf_dir)["leads_stg"])


@query("order_touches")
def q_order_touches(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.order_touches(won, t)


@query("first_touch")
def q_first_touch(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.first_touch(won, t)


@query("last_touch")
def q_last_touch(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.last_touch(won, t)


@query("linear_touch")
def q_linear_touch(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.linear_touch(won, t)


@query("first_touch_by_channel")
def q_first_by_channel(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.single_touch_by_channel(A.first_channel(won, t))


@query("last_touch_by_channel")
def q_last_by_channel(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.single_touch_by_channel(A.last_channel(won, t))


@query("linear_by_channel")
def q_linear_by_channel(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.linear_by_channel(A.linear_touch(won, t))


@query("linear_credit_by_channel")
def q_linear_credit_by_channel(spark, sf_dir):
    """``linear_by_channel`` without a row per order and channel."""
    _, won, t = _ctx(spark, sf_dir)
    return A.linear_credit_by_channel(won, t)


@query("first_touch_by_month")
def q_first_by_month(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.single_touch_by_month(A.first_channel(won, t))


@query("last_touch_by_month")
def q_last_by_month(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.single_touch_by_month(A.last_channel(won, t))


@query("linear_by_month")
def q_linear_by_month(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.linear_by_month(A.linear_touch(won, t))


@query("attribution_by_utm_medium")
def q_by_utm_medium(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.attribution_by(won, t, "utm_medium")


@query("attribution_by_utm_campaign")
def q_by_utm_campaign(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.attribution_by(won, t, "utm_campaign")


@query("first_touch_by_month_refreshed")
def q_first_by_month_refreshed(spark, sf_dir):
    """``first_touch_by_month`` as a stored mart, refreshed after February's sales have come in."""
    _, won, t = _ctx(spark, sf_dir)
    details = written(A.first_channel(won, t).withColumn("month_start", month_start("booked_at")), "first-touch")
    mart = MonthlyMart(spark, scratch_path(spark, "first-touch-by-month"), A.single_touch_by_month)
    mart.refresh(details.where(F.month("booked_at") != 2))
    mart.refresh(details)
    return mart.read()


@query("qa_reconcile")
def q_qa_reconcile(spark, sf_dir):
    cat, won, _ = _ctx(spark, sf_dir)
    return A.qa_reconcile(cat["sales_stg"], cat["opportunities_stg"], won)


@query("qa_untouched")
def q_qa_untouched(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return A.qa_untouched(won, t)


@query("touch_index")
def q_touch_index(spark, sf_dir):
    """Every touch of a contact with its place in the contact's path (W1-W3)."""
    return touch_index(touches_from(driver.load(spark, sf_dir))).select("contact_id", "touch_no", "ts", "touch_type", "touch_id")


@query("order_path_ends")
def q_order_path_ends(spark, sf_dir):
    """Won sales with the length of their touch path, its first and its last touch (R5)."""
    _, won, t = _ctx(spark, sf_dir)
    return order_path_ends(won, t)


@query("touches_by_medium_collated")
def q_touches_by_medium_collated(spark, sf_dir):
    """Touches by UTM medium, compared without case and trailing spaces (D5)."""
    return group_collated(touches_from(driver.load(spark, sf_dir)), F.ltrim("utm_medium"), "utm_medium")


# ---- influence ------------------------------------------------------------
@query("opportunity_touches")
def q_opportunity_touches(spark, sf_dir):
    cat, _, t = _ctx(spark, sf_dir)
    return INF.opportunity_touches(cat["opportunities_stg"], cat["leads_stg"], t)


@query("opp_influence")
def q_opp_influence(spark, sf_dir):
    cat, _, t = _ctx(spark, sf_dir)
    return INF.opp_influence(cat["opportunities_stg"], cat["leads_stg"], t)


@query("pipeline_influence")
def q_pipeline_influence(spark, sf_dir):
    cat, _, t = _ctx(spark, sf_dir)
    return INF.pipeline_influence(cat["opportunities_stg"], cat["leads_stg"], t)


@query("customer_influence")
def q_customer_influence(spark, sf_dir):
    _, won, t = _ctx(spark, sf_dir)
    return INF.customer_influence(won, t)


# ---- funnel ---------------------------------------------------------------
def _funnel_args(spark, sf_dir):
    cat = driver.load(spark, sf_dir)
    return cat, (cat["leads_stg"], cat["opportunities_stg"], cat["sales_stg"])


@query("lead_funnel")
def q_lead_funnel(spark, sf_dir):
    return FN.lead_funnel(*_funnel_args(spark, sf_dir)[1])


@query("funnel_by_month")
def q_funnel_by_month(spark, sf_dir):
    return FN.funnel_by_month(*_funnel_args(spark, sf_dir)[1])


@query("overview_by_month")
def q_overview_by_month(spark, sf_dir):
    cat, args = _funnel_args(spark, sf_dir)
    return FN.overview_by_month(*args, cat["spend_stg"])


def _store(spark, sf_dir) -> StagedStore:
    store = StagedStore(spark)
    store_deals(store, *_funnel_args(spark, sf_dir)[1])
    return store


@query("stored_leads")
def q_stored_leads(spark, sf_dir):
    """leads_stg stored by lead_id and read back (SELECT * INTO)."""
    return StagedStore(spark).store("leads_stg", driver.load(spark, sf_dir)["leads_stg"], "lead_id")


@query("stored_won_sales")
def q_stored_won_sales(spark, sf_dir):
    """The sale -> opportunity -> lead chain over stored tables, bucket by bucket."""
    return stored_won_sales(_store(spark, sf_dir))


@query("stored_lead_funnel")
def q_stored_lead_funnel(spark, sf_dir):
    """The funnel over stored tables."""
    return FN.funnel(stored_lead_base(_store(spark, sf_dir)), F.col("lead_source"), "lead_source").orderBy(F.desc_nulls_last("closed_won_revenue"))


@query("lead_funnel_bitmaps")
def q_lead_funnel_bitmaps(spark, sf_dir):
    return BM.funnel_by_source(*_funnel_args(spark, sf_dir)[1])


@query("funnel_by_month_bitmaps")
def q_funnel_by_month_bitmaps(spark, sf_dir):
    return BM.funnel_by_month(*_funnel_args(spark, sf_dir)[1])


# ---- LTV / CAC ------------------------------------------------------------
def _segments(cat) -> DataFrame:
    return LTV.ltv_segments(cat["subscriptions_stg"], cat["accounts_stg"], cat["abm_accounts_stg"])


@query("overall_cac")
def q_overall_cac(spark, sf_dir):
    cat = driver.load(spark, sf_dir)
    return LTV.overall_cac(cat["spend_stg"], cat["sales_stg"])


@query("account_ltv")
def q_account_ltv(spark, sf_dir):
    return LTV.account_ltv(driver.load(spark, sf_dir)["subscriptions_stg"])


@query("ltv_segments")
def q_ltv_segments(spark, sf_dir):
    return _segments(driver.load(spark, sf_dir))


@query("ltv_by_abm")
def q_ltv_by_abm(spark, sf_dir):
    return LTV.ltv_by_abm(_segments(driver.load(spark, sf_dir)))


@query("ltv_by_industry")
def q_ltv_by_industry(spark, sf_dir):
    return LTV.ltv_by_industry(_segments(driver.load(spark, sf_dir)))


@query("ltv_by_segment")
def q_ltv_by_segment(spark, sf_dir):
    return LTV.ltv_by_segment(_segments(driver.load(spark, sf_dir)))


@query("overall_ltv")
def q_overall_ltv(spark, sf_dir):
    return LTV.overall_ltv(driver.load(spark, sf_dir)["subscriptions_stg"])


@query("spend_vs_attribution")
def q_spend_vs_attribution(spark, sf_dir):
    cat, won, t = _ctx(spark, sf_dir)
    return LTV.spend_vs_attribution(cat["spend_stg"], A.single_touch_by_month(A.first_channel(won, t)))


# ---- staging --------------------------------------------------------------
def _stage(table: str):
    def run(spark, sf_dir):
        return driver.load(spark, sf_dir)[table]
    return run


for _key, _table in [("stage_accounts", "accounts_stg"), ("stage_abm_accounts", "abm_accounts_stg"),
                     ("stage_contacts", "crm_contacts_stg"), ("stage_leads", "leads_stg"),
                     ("stage_opportunities", "opportunities_stg"), ("stage_sales", "sales_stg"),
                     ("stage_sales_activities", "sales_activities_stg"),
                     ("stage_email_engagement", "email_engagement_stg"),
                     ("stage_content_engagement", "content_engagement_stg"),
                     ("stage_seo", "seo_search_console_stg"), ("stage_spend", "spend_stg"),
                     ("stage_passthrough", "campaigns_stg"), ("stage_assets", "assets_stg"),
                     ("stage_web_pageviews", "web_pageviews_stg"),
                     ("stage_web_sessions", "web_sessions_stg")]:
    REGISTRY[_key] = _stage(_table)


# ---- data quality ---------------------------------------------------------
@query("dup_keys")
def q_dup_keys(spark, sf_dir):
    return Q.duplicate_rows(driver.load(spark, sf_dir)["leads"], ["lead_id"])


@query("dedup_preview")
def q_dedup_preview(spark, sf_dir):
    return Q.dedup_preview(driver.load(spark, sf_dir)["leads"], ["lead_id"], "first_response_at",
                           descending=False)


@query("dedup_latest")
def q_dedup_latest(spark, sf_dir):
    """Most recent lead of each contact."""
    leads = driver.load(spark, sf_dir)["leads_stg"]
    return keep_one(leads, ["contact_id"], "created_at", descending=True, tie_break=["lead_id"])


@query("dedup_earliest")
def q_dedup_earliest(spark, sf_dir):
    """First opportunity of each lead (several per lead, and repeated ids)."""
    opps = driver.load(spark, sf_dir)["opportunities_stg"]
    return keep_one(opps, ["lead_id"], "created_at", descending=False, tie_break=["opportunity_id"])


@query("dedup_latest_in_batches")
def q_dedup_latest_in_batches(spark, sf_dir):
    """``dedup_latest`` from a stored winner table: two batches, the first one arriving twice."""
    leads = driver.load(spark, sf_dir)["leads_stg"]
    table = WinnerTable(spark, scratch_path(spark, "latest-leads"), leads.schema, ["contact_id"], "created_at", True, ["lead_id"])
    half = F.crc32("lead_id") % 2
    for batch in (0, 1, 0):
        table.merge(leads.where(half == batch))
    return table.read()


@query("invalid_emails")
def q_invalid_emails(spark, sf_dir):
    return Q.invalid_emails(STG.clean_contacts(driver.load(spark, sf_dir)["crm_contacts"]))


@query("domain_values")
def q_domain_values(spark, sf_dir):
    cat = driver.load(spark, sf_dir)
    parts = [Q.domain_values(cat[t], *cols).select(F.lit(t).alias("table"), "column", "value", "rows")
             for t, cols in DOMAIN_COLUMNS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("distinct_account_names")
def q_distinct_account_names(spark, sf_dir):
    return Q.distinct_count(driver.load(spark, sf_dir)["accounts_stg"], "account_name",
                            "distinct_account_name_count")


@query("lookup_key")
def q_lookup_key(spark, sf_dir):
    return Q.lookup_key(driver.load(spark, sf_dir)["leads_stg"], "contact_id", LOOKUP_CONTACT_ID)


@query("date_rejects")
def q_date_rejects(spark, sf_dir):
    raw = driver.load(spark, sf_dir)["crm_contacts"]
    return Q.rejects(raw, STG.conversions("crm_contacts", raw))


@query("convert_rejects")
def q_convert_rejects(spark, sf_dir):
    """Values that became NULL, for every converted date and amount column."""
    cat = driver.load(spark, sf_dir)
    tables = [*STG.DATE_COLUMNS, *STG.MONEY_COLUMNS]
    return Q.table_rejects({t: (cat[t], STG.conversions(t, cat[t])) for t in tables})


@query("staged_rejects")
def q_staged_rejects(spark, sf_dir):
    """The counts of ``convert_rejects`` as metrics of the staging writes: one scan a table."""
    cat = driver.load(spark, sf_dir)
    rows = []
    for t in [*STG.DATE_COLUMNS, *STG.MONEY_COLUMNS]:
        _, counts = Q.observed_rejects(STG.PIPELINES[t], cat[t], STG.conversions(t, cat[t]), t)
        rows += [(t, c, n) for c, n in counts.items()]
    return spark.createDataFrame(rows, "table string, column string, rejected bigint")


@query("dup_key_checks")
def q_dup_key_checks(spark, sf_dir):
    """The eight key checks of the cleaning scripts, over the raw tables."""
    cat = driver.load(spark, sf_dir)
    return Q.duplicate_keys({name: (cat[t], [key]) for name, (t, key) in DUPLICATE_CHECKS.items()})


@query("dup_keys_filtered")
def q_dup_keys_filtered(spark, sf_dir):
    """Rows of repeated lead ids; a counting Bloom filter keeps unique ids out of the shuffles."""
    return R.duplicate_rows(driver.load(spark, sf_dir)["leads"], ["lead_id"])


@query("dup_key_checks_filtered")
def q_dup_key_checks_filtered(spark, sf_dir):
    cat = driver.load(spark, sf_dir)
    return R.duplicate_keys({name: (cat[t], [key]) for name, (t, key) in DUPLICATE_CHECKS.items()})


@query("dedup_preview_filtered")
def q_dedup_preview_filtered(spark, sf_dir):
    return R.dedup_preview(driver.load(spark, sf_dir)["leads"], ["lead_id"], "first_response_at", descending=False)


@query("profile_table")
def q_profile_table(spark, sf_dir):
    cat = driver.load(spark, sf_dir)
    return Q.profile_with_dictionary(cat["accounts_stg"], "accounts_stg", ["account_id"])


# ---- sink -------------------------------------------------------------------
EXPORT_SCHEMA = T.StructType([T.StructField("month_start", T.DateType()),
                              T.StructField("channel", T.StringType()),
                              T.StructField("customers_acquired", T.LongType()),
                              T.StructField("total_revenue", T.DecimalType(38, 2))])


@query("export_mart")
def q_export_mart(spark, sf_dir):
    """first_touch_by_month written as CSV to the shared folder and read back."""
    path = scratch_path(spark, "first_touch_by_month")
    export_report(q_first_by_month(spark, sf_dir), path, order_by=["month_start", "channel"])
    return read_back(spark, path, schema=EXPORT_SCHEMA)
