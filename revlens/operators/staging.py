"""Staging pipelines: raw CRM table -> cleaned ``*_stg`` table.

Each in-place UPDATE / ALTER COLUMN / rename of the original scripts becomes
one expression of a single projection, so a pipeline is one narrow stage
(plus one aggregation where it de-duplicates).  Writing the result is the
caller's choice (``sources.marts.write_table``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import parse_date, snake, to_money, trim_lower, replace_literal
from revlens.functions.dates import DEFAULT_DATE_FORMATS
from revlens.operators.dedup import keep_one

# Fixed values taken from the cleaning scripts.
OBFUSCATED_AT = " [at] "


def _with(df: DataFrame, **exprs) -> DataFrame:
    """Replace columns in place, keeping column order."""
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


# Columns that a staging pipeline converts, by raw table; quality.rejects
# counts the values that do not convert.
DATE_COLUMNS = {
    "crm_contacts": ["created_at"], "leads": ["created_at", "first_response_at"],
    "opportunities": ["created_at", "close_date"], "sales": ["booked_at"], "sales_activities": ["ts"],
    "email_engagement": ["sent_at"], "content_engagement": ["engaged_at"],
}
MONEY_COLUMNS = {"accounts": ["current_mrr"], "spend": ["spend"], "seo_search_console": ["avg_position"]}


def conversions(table: str, raw: DataFrame) -> dict[str, Column]:
    """Converted column -> its expression over the raw table, as its pipeline has it."""
    dates = {c: _to_date(raw, c) for c in DATE_COLUMNS.get(table, []) if c in raw.columns}
    return dates | {c: to_money(c) for c in MONEY_COLUMNS.get(table, []) if c in raw.columns}


def stage_passthrough(raw: DataFrame) -> DataFrame:
    """Copy a table unchanged (assets, campaigns, web_pageviews, web_sessions)."""
    return raw


def stage_abm_accounts(raw: DataFrame) -> DataFrame:
    """target_reason: trim, lower case, spaces to underscores."""
    return _with(raw, target_reason=snake("target_reason"))


def stage_accounts(raw: DataFrame) -> DataFrame:
    """Name to snake case; industry, region, plan trimmed and lower-cased;
    current_mrr to DECIMAL(10,2); plan renamed subscription_plan."""
    out = _with(raw,
                account_name=snake("account_name"),
                industry=trim_lower("industry"),
                region=trim_lower("region"),
                current_mrr=to_money("current_mrr"),
                plan=trim_lower("plan"))
    return out.withColumnRenamed("plan", "subscription_plan")


def clean_contacts(raw: DataFrame, date_formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Contacts before de-duplication: email trimmed, lower-cased and
    de-obfuscated, created_at to DATE, lead_source renamed contact_source."""
    email = replace_literal(trim_lower("email"), OBFUSCATED_AT, "@")
    created = (parse_date("created_at", date_formats) if dict(raw.dtypes)["created_at"] == "string"
               else F.col("created_at").cast("date"))
    out = _with(raw, email=email, created_at=created)
    return out.withColumnRenamed("lead_source", "contact_source")


def stage_contacts(raw: DataFrame, date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
                   tie_break: Sequence[str] = ("rid",)) -> DataFrame:
    """Clean, then keep the most recent record per contact_id.

    Ordering is on the converted DATE (the conversion runs first), so two
    records of one day tie; ``tie_break`` (descending) settles that.
    """
    cleaned = clean_contacts(raw, date_formats)
    tie = [c for c in tie_break if c in cleaned.columns]
    return keep_one(cleaned, ["contact_id"], "created_at", descending=True, tie_break=tie)


def stage_leads(raw: DataFrame) -> DataFrame:
    """Keep the earliest first_response_at per lead_id (NULL counts as
    earliest), ordering on the raw timestamp; then both dates to DATE."""
    kept = keep_one(raw, ["lead_id"], "first_response_at", descending=False)
    return _dates(kept, "created_at", "first_response_at")


def _to_date(raw: DataFrame, c: str):
    """Text goes through the multi-format parser; dates and timestamps cast."""
    if dict(raw.dtypes)[c] == "string":
        return parse_date(c)
    return F.col(c).cast("date")


def _dates(raw: DataFrame, *cols: str) -> DataFrame:
    return _with(raw, **{c: _to_date(raw, c) for c in cols if c in raw.columns})


def stage_opportunities(raw: DataFrame) -> DataFrame:
    """created_at and close_date to DATE (duplicate keys are reported, not removed)."""
    return _dates(raw, "created_at", "close_date")


def stage_sales(raw: DataFrame) -> DataFrame:
    """booked_at to DATE (duplicate order_ids are reported, not removed)."""
    return _dates(raw, "booked_at")


def stage_sales_activities(raw: DataFrame) -> DataFrame:
    """ts to DATE."""
    return _dates(raw, "ts")


def stage_email_engagement(raw: DataFrame) -> DataFrame:
    """sent_at to DATE."""
    return _dates(raw, "sent_at")


def stage_content_engagement(raw: DataFrame) -> DataFrame:
    """engaged_at to DATE."""
    return _dates(raw, "engaged_at")


def stage_seo(raw: DataFrame) -> DataFrame:
    """avg_position to DECIMAL(10,2)."""
    return _with(raw, avg_position=to_money("avg_position"))


def stage_spend(raw: DataFrame) -> DataFrame:
    """spend to DECIMAL(10,2)."""
    return _with(raw, spend=to_money("spend"))


# Raw table -> its pipeline; the staged table is named <raw>_stg.
PIPELINES = {
    "accounts": stage_accounts, "abm_accounts": stage_abm_accounts, "crm_contacts": stage_contacts,
    "leads": stage_leads, "opportunities": stage_opportunities, "sales": stage_sales,
    "sales_activities": stage_sales_activities, "email_engagement": stage_email_engagement,
    "content_engagement": stage_content_engagement, "seo_search_console": stage_seo, "spend": stage_spend,
    "web_sessions": stage_passthrough, "web_pageviews": stage_passthrough, "assets": stage_passthrough,
    "campaigns": stage_passthrough, "subscriptions": stage_passthrough,
}


def register_staged(cat, names) -> None:
    """Register the staged table of each raw table of a catalog."""
    for name in names:
        cat.register(f"{name}_stg", lambda name=name: PIPELINES[name](cat[name]))
