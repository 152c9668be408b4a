"""Hand-written mini fixtures (FIXTURES.md section 2).

Each holds the edge cases the driver tables cannot show.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from revlens.sources.schemas import STAGED, S

D = dt.date
T = dt.datetime


def frame(spark, table, rows):
    """A staged table from rows; numbers given for text keys become text, and columns left out at the end are NULL."""
    fields = STAGED[table].fields
    text = [f.dataType == S for f in fields]
    full = [tuple(r) + (None,) * (len(fields) - len(r)) for r in rows]
    return spark.createDataFrame([tuple(str(v) if t and v is not None else v for v, t in zip(r, text, strict=True)) for r in full], STAGED[table])


# ---- sales_edge + opps for attribution -------------------------------------
# contacts: 1 (two orders, 100.00 over 3 touches), 2 (tie at one instant,
# NULL channel), 4 (no touch), 5 (shares order_id 2 with contact 2)
LEADS = [
    (1, 1, "web", D(2024, 1, 1), None, 1, 1),
    (2, 2, "email", D(2024, 1, 1), None, 1, 0),
    (3, 3, "web", D(2024, 1, 1), None, 0, 0),
    (4, 4, None, D(2024, 1, 2), None, 1, 1),
    (5, 5, "paid", D(2024, 2, 2), None, 0, 0),
]
OPPS = [
    (11, 1, "won", Decimal("100.00"), D(2024, 1, 2), None, 1),
    (12, 2, "won", Decimal("250.00"), D(2024, 1, 4), None, 1),
    (13, 3, "lost", Decimal("999.00"), D(2024, 1, 4), None, 0),   # lost opportunity
    (14, 4, "won", Decimal("50.00"), D(2024, 1, 4), None, 1),
    (15, 99, "won", Decimal("70.00"), D(2024, 1, 4), None, 1),    # lead missing
    (16, 1, "won", Decimal("300.00"), D(2024, 1, 20), None, 1),   # second order of contact 1
    (17, 5, "won", Decimal("40.00"), D(2024, 1, 5), None, 1),
]
SALES = [
    (1, 11, Decimal("100.00"), D(2024, 1, 10)),
    (2, 12, Decimal("250.00"), D(2024, 1, 15)),
    (3, 13, Decimal("999.00"), D(2024, 1, 15)),
    (4, 14, Decimal("50.00"), D(2024, 1, 15)),    # order without touch
    (5, 15, Decimal("70.00"), D(2024, 1, 15)),    # order without lead
    (6, 16, Decimal("300.00"), D(2024, 2, 1)),
    (2, 17, Decimal("40.00"), D(2024, 1, 20)),    # duplicate order_id 2
]

# ---- touches_edge ---------------------------------------------------------
WEB = [
    # contact, started_at, channel, campaign_id, utm_source, utm_medium, utm_campaign, touch_id
    (1, T(2024, 1, 1, 9), "paid", 1, "google", "cpc", "c1", 101),
    (1, T(2024, 1, 2, 9), "paid", None, "google", "cpc", "c1", 102),       # NULL campaign: no touch
    (1, T(2024, 1, 10, 8), "paid", 3, "google", "cpc", "c3", 103),       # 08:00 on booking day
    (1, T(2024, 1, 12, 0), "organic", 2, "seo", None, "c2", 104),
    (2, T(2024, 1, 3, 10), None, 5, None, None, None, 105),              # NULL channel
    (2, T(2024, 1, 3, 10), "email", 5, "nl", "email", "c5", 106),        # same instant, web 'email'
    (None, T(2024, 1, 3, 10), "paid", 5, "google", "cpc", "c5", 107),    # NULL contact
]
EMAIL = [
    # contact, sent_at, utm_source, utm_medium, utm_campaign, touch_id
    (1, D(2024, 1, 10), "nl", "email", "c9", 201),   # on the booking day: counts
    (2, D(2024, 1, 16), "nl", "email", "c9", 202),   # the day after the booking
    (5, D(2024, 1, 18), "nl", "email", "c9", 203),
]
ACTIVITIES = [
    # activity_id, contact, ts, type, outcome
    (301, 1, D(2024, 1, 3), "call", "connected"),
    (302, 1, D(2024, 1, 4), "call", "no_answer"),
    (303, 2, D(2024, 1, 3), "call", None),          # NULL outcome: no touch
    (304, 5, D(2024, 1, 20), "meeting", "connected"),
]


def attribution_tables(spark):
    return {
        "leads_stg": frame(spark, "leads_stg", LEADS),
        "opportunities_stg": frame(spark, "opportunities_stg", OPPS),
        "sales_stg": frame(spark, "sales_stg", SALES),
        "web_sessions_stg": frame(spark, "web_sessions_stg", WEB),
        "email_engagement_stg": frame(spark, "email_engagement_stg", EMAIL),
        "sales_activities_stg": frame(spark, "sales_activities_stg", ACTIVITIES),
    }


# ---- subs_edge / cac_edge ---------------------------------------------------
SUBS = [
    (1, Decimal("10.00"), "active"), (1, Decimal("10.00"), "active"),
    (2, Decimal("20.00"), "churned"), (2, Decimal("20.00"), "active"),   # churned then active
    (2, Decimal("20.00"), "active"),
    (3, Decimal("5.00"), "active"),                                       # not in accounts
    (4, Decimal("7.50"), "active"),
]
ACCOUNTS = [
    (1, "a", "saas", "1-10", "emea", Decimal("1.00"), "pro"),
    (2, "b", "saas", "11-50", "na", Decimal("2.00"), "basic"),
    (4, "d", "retail", "1-10", "na", Decimal("3.00"), "pro"),
]
ABM = [(2, "high_value", "tier_1"), (2, "high_value", "tier_1")]        # duplicate ABM row
SPEND = [(D(2024, 1, 1), "paid", Decimal("100.00")), (D(2024, 2, 1), "email", Decimal("50.00"))]
