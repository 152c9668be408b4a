"""Refresh every report mart in one run.

The original scripts recompute the whole touch chain for each report.  Here
won sales and touches are written once to the shared checkpoint folder (a
written table cuts the lineage and lets every report read them instead of
recomputing joins and unions), then each report is written to
``out_dir/<name>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from revlens.operators import attribution as A
from revlens.operators import funnel as FN
from revlens.operators import influence as INF
from revlens.operators import ltv as LTV
from revlens.operators.touches import touches_from
from revlens.session import written
from revlens.sources.catalog import Catalog
from revlens.sources.marts import write_table


def mart_builders(cat: Catalog, won: DataFrame, touches: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Report name -> builder, over a catalog and written won sales / touches.

    Details that several reports read (first, last and linear touch, account
    segments) are written once, when the first report asks for them.
    """
    leads, opps, sales = cat["leads_stg"], cat["opportunities_stg"], cat["sales_stg"]
    details: dict[str, DataFrame] = {}

    def detail(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in details:
            details[name] = written(build(), name)
        return details[name]

    first = lambda: detail("first-touch", lambda: A.first_channel(won, touches))
    last = lambda: detail("last-touch", lambda: A.last_channel(won, touches))
    linear = lambda: detail("linear-touch", lambda: A.linear_touch(won, touches))
    segments = lambda: detail("segments", lambda: LTV.ltv_segments(
        cat["subscriptions_stg"], cat["accounts_stg"], cat["abm_accounts_stg"]))
    by_month = lambda: detail("first-by-month", lambda: A.single_touch_by_month(first()))

    return {
        "first_touch_by_channel": lambda: A.single_touch_by_channel(first()),
        "last_touch_by_channel": lambda: A.single_touch_by_channel(last()),
        "linear_by_channel": lambda: A.linear_by_channel(linear()),
        "first_touch_by_month": by_month,
        "last_touch_by_month": lambda: A.single_touch_by_month(last()),
        "linear_by_month": lambda: A.linear_by_month(linear()),
        "attribution_by_utm_medium": lambda: A.attribution_by(won, touches, "utm_medium"),
        "attribution_by_utm_campaign": lambda: A.attribution_by(won, touches, "utm_campaign"),
        "opp_influence": lambda: INF.opp_influence(opps, leads, touches),
        "pipeline_influence": lambda: INF.pipeline_influence(opps, leads, touches),
        "customer_influence": lambda: INF.customer_influence(won, touches),
        "lead_funnel": lambda: FN.lead_funnel(leads, opps, sales),
        "funnel_by_month": lambda: FN.funnel_by_month(leads, opps, sales),
        "overview_by_month": lambda: FN.overview_by_month(leads, opps, sales, cat["spend_stg"]),
        "overall_cac": lambda: LTV.overall_cac(cat["spend_stg"], sales),
        "ltv_by_abm": lambda: LTV.ltv_by_abm(segments()),
        "ltv_by_industry": lambda: LTV.ltv_by_industry(segments()),
        "ltv_by_segment": lambda: LTV.ltv_by_segment(segments()),
        "overall_ltv": lambda: LTV.overall_ltv(cat["subscriptions_stg"]),
        "spend_vs_attribution": lambda: LTV.spend_vs_attribution(cat["spend_stg"], by_month()),
    }


def refresh_marts(cat: Catalog, out_dir: str, fmt: str = "parquet",
                  only: list[str] | None = None) -> dict[str, str]:
    """Write every report (or ``only`` those) under ``out_dir``; returns name -> path.

    The loop runs over the fixed list of report names; each report is one
    distributed job writing in parallel.
    """
    won = written(A.won_sales(cat["sales_stg"], cat["opportunities_stg"], cat["leads_stg"]), "won_sales")
    touches = written(touches_from(cat), "touches")
    builders = mart_builders(cat, won, touches)
    paths = {}
    for name in only or list(builders):
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        write_table(builders[name](), paths[name], fmt=fmt)
    return paths
