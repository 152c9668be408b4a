"""Unified marketing/sales touches (web, email, sales activity)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import as_timestamp_ntz, trim_lower, varchar

# Fixed values from the attribution scripts.
EMAIL_TOUCH = "email"
SALES_TOUCH = "sales"
NOT_A_TOUCH_OUTCOME = "no_answer"
TOUCH_TYPE_LENGTH = 50

TOUCH_COLUMNS = ["contact_id", "ts", "touch_type", "source_label", "campaign_id",
                 "utm_source", "utm_medium", "utm_campaign", "touch_id"]


def _touch_id(df: DataFrame, id_cols: list[str], fallback_cols: list[str]):
    """The source row's own id as text; a hash of its fields where it has none."""
    for c in id_cols:
        if c in df.columns:
            return F.col(c).cast("string")
    return F.xxhash64(*[F.col(c) for c in fallback_cols]).cast("string")


def touches(web_sessions: DataFrame, email_engagement: DataFrame,
            sales_activities: DataFrame, normalize: bool = False,
            channel_length: int = TOUCH_TYPE_LENGTH) -> DataFrame:
    """All touches, one row each.

    * web session with a campaign_id; its channel is the session's own
      ``channel`` value, cut to ``channel_length`` characters (two channels
      with that many first characters in common become one, as in the
      original cast);
    * every email engagement, channel ``email``;
    * sales activity whose outcome is not ``no_answer`` (a NULL outcome is
      not a touch either), channel ``sales``.

    Contact and campaign ids keep their own type.  Email and activity dates
    become midnight timestamps.  ``touch_id`` (the source row's id, or the
    activity id) is the last tie-break of first/last touch.  With
    ``normalize`` the channel and UTM texts are trimmed and lower-cased.
    """
    null_s = F.lit(None).cast("string")
    null_campaign = F.lit(None).cast(web_sessions.schema["campaign_id"].dataType).alias("campaign_id")
    web = web_sessions.where(F.col("campaign_id").isNotNull()).select(
        "contact_id", as_timestamp_ntz("started_at").alias("ts"),
        varchar("channel", channel_length).alias("touch_type"), null_s.alias("source_label"),
        "campaign_id", "utm_source", "utm_medium", "utm_campaign",
        _touch_id(web_sessions, ["touch_id"], ["contact_id", "started_at", "channel", "campaign_id"]).alias("touch_id"))
    email = email_engagement.select(
        "contact_id", as_timestamp_ntz("sent_at").alias("ts"),
        F.lit(EMAIL_TOUCH).alias("touch_type"), null_s.alias("source_label"),
        null_campaign, "utm_source", "utm_medium", "utm_campaign",
        _touch_id(email_engagement, ["touch_id"], ["contact_id", "sent_at", "utm_campaign"]).alias("touch_id"))
    sales = sales_activities.where(F.col("outcome") != NOT_A_TOUCH_OUTCOME).select(
        "contact_id", as_timestamp_ntz("ts").alias("ts"),
        F.lit(SALES_TOUCH).alias("touch_type"), F.col("type").alias("source_label"),
        null_campaign, null_s.alias("utm_source"), null_s.alias("utm_medium"),
        null_s.alias("utm_campaign"),
        _touch_id(sales_activities, ["touch_id", "activity_id"], ["contact_id", "ts", "type"]).alias("touch_id"))
    out = web.unionByName(email).unionByName(sales)
    if normalize:
        out = out.select(*[trim_lower(c).alias(c) if c in ("touch_type", "utm_source", "utm_medium",
                                                         "utm_campaign") else F.col(c)
                           for c in TOUCH_COLUMNS])
    return out


def touches_from(cat) -> DataFrame:
    """touches() over the staged tables of a catalog."""
    return touches(cat["web_sessions_stg"], cat["email_engagement_stg"], cat["sales_activities_stg"])
