"""Declared schemas of the raw and staged CRM tables, with their keys.

No DDL of the tables exists; columns are those the scripts use and types are
the ones their conversions prove (DATE, DECIMAL(10,2)), else chosen.  Keys
are text, as in CON100000 or ACC1236.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Staged tables: the contract the analytic operators read.
STAGED = {
    "accounts_stg": _schema(("account_id", S), ("account_name", S), ("industry", S),
                            ("employee_bucket", S), ("region", S), ("current_mrr", MONEY),
                            ("subscription_plan", S)),
    "abm_accounts_stg": _schema(("account_id", S), ("target_reason", S), ("abm_tier", S)),
    "crm_contacts_stg": _schema(("contact_id", S), ("email", S), ("created_at", D),
                                ("contact_source", S), ("rid", L)),
    "leads_stg": _schema(("lead_id", S), ("contact_id", S), ("source", S), ("created_at", D),
                         ("first_response_at", D), ("mql_flag", I), ("sql_flag", I)),
    "opportunities_stg": _schema(("opportunity_id", S), ("lead_id", S), ("stage", S),
                                 ("amount", MONEY), ("created_at", D), ("close_date", D), ("win_flag", I)),
    "sales_stg": _schema(("order_id", S), ("opportunity_id", S), ("booked_amount", MONEY),
                         ("booked_at", D)),
    "web_sessions_stg": _schema(("contact_id", S), ("started_at", TS), ("channel", S),
                                ("campaign_id", S), ("utm_source", S), ("utm_medium", S),
                                ("utm_campaign", S), ("touch_id", S)),
    "email_engagement_stg": _schema(("contact_id", S), ("sent_at", D), ("utm_source", S),
                                    ("utm_medium", S), ("utm_campaign", S), ("touch_id", S)),
    "sales_activities_stg": _schema(("activity_id", S), ("contact_id", S), ("ts", D),
                                    ("type", S), ("outcome", S)),
    "content_engagement_stg": _schema(("content_id", S), ("contact_id", S), ("engaged_at", D)),
    "subscriptions_stg": _schema(("account_id", S), ("mrr", MONEY), ("status", S)),
    "spend_stg": _schema(("month_start", D), ("channel", S), ("spend", MONEY)),
    "seo_search_console_stg": _schema(("page_key", S), ("avg_position", MONEY)),
}

# Columns that a staging pipeline renames, staged -> raw.
RENAMED = {"accounts_stg": {"subscription_plan": "plan"}, "crm_contacts_stg": {"contact_source": "lead_source"}}

# Declared (not enforced) keys; quality.duplicate_keys checks them.
KEYS = {
    "accounts_stg": ["account_id"],
    "abm_accounts_stg": ["account_id"],
    "crm_contacts_stg": ["contact_id"],
    "leads_stg": ["lead_id"],
    "opportunities_stg": ["opportunity_id"],
    "sales_stg": ["order_id"],
    "sales_activities_stg": ["activity_id"],
}

# Raw tables whose key the cleaning scripts check for repeats: check -> (raw table, key).
DUPLICATE_CHECKS = {
    "abm_accounts.account_id": ("abm_accounts", "account_id"),
    "accounts.account_id": ("accounts", "account_id"),
    "crm_contacts.contact_id": ("crm_contacts", "contact_id"),
    "leads.lead_id": ("leads", "lead_id"),
    "opportunities.opportunity_id": ("opportunities", "opportunity_id"),
    "opportunities.lead_id": ("opportunities", "lead_id"),
    "sales.order_id": ("sales", "order_id"),
    "sales_activities.activity_id": ("sales_activities", "activity_id"),
}


def raw_types(table: str) -> dict[str, T.DataType]:
    """Types a raw table's text columns are read as; dates and converted amounts stay text for the staging pipeline."""
    from revlens.operators.staging import DATE_COLUMNS, MONEY_COLUMNS

    staged = f"{table}_stg"
    renamed = RENAMED.get(staged, {})
    later = {*DATE_COLUMNS.get(table, []), *MONEY_COLUMNS.get(table, [])}
    return {renamed.get(f.name, f.name): f.dataType for f in STAGED[staged].fields if renamed.get(f.name, f.name) not in later}


def dictionary_rows() -> list[tuple[str, str, str, bool]]:
    """(table, column, type, is_key) rows of the data dictionary."""
    rows = []
    for table, schema in STAGED.items():
        keys = set(KEYS.get(table, []))
        for f in schema.fields:
            rows.append((table, f.name, f.dataType.simpleString(), f.name in keys))
    return rows
