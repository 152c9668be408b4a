"""Revenue attribution: first touch, last touch, linear.

Semantics (kept from the original scripts)
-----------------------------------------
* A won sale is a sales row whose opportunity has ``win_flag = 1``, tied to
  a contact through opportunity -> lead.
* A touch qualifies for an order when it belongs to the order's contact and
  ``touch.ts <= booked_at`` (a DATE, compared as midnight: a web touch later
  on the booking day does not count, an email or sales touch that day does).
* First / last touch: the earliest / latest qualifying touch of the order,
  ties broken by ``touch_type``; of rows that repeat an order_id then by
  amount, booking day and contact; last by ``touch_id`` (all ascending for
  first, descending for last).  Linear: each qualifying touch gets
  ``sale_amount / touches_per_order``.
* Rows sharing an order_id form one group, as ``PARTITION BY order_id`` did.

Plan shape
----------
The literal form joins every order to every earlier touch of its contact
and ranks the pairs: with a hot contact that is O(orders x touches) rows in
one task.  Here no pair is formed.  The qualifying touches of an order are
the prefix of its contact's touches up to the booking day, so:

1. touches are reduced by a hash aggregate to one row per
   ``(contact, day, channel)`` with a count and the first and last instant,
   where ``day = day_ceiling(ts)`` (``ts <= D`` iff ``day <= D``);
2. the distinct booking days of the contact's won sales are inserted as
   query points, and one running window per contact (or contact and channel)
   accumulates count, first and last up to each query point.  A window group
   holds at most (distinct days) rows, whatever the contact's volume;
3. won sales join the state on ``(contact, booking day)`` (many-to-one; with
   a shuffle on both sides, which AQE splits where one key is hot);
4. what rows of one order_id share (the linear divisor) is aggregated,
   written, and joined back, so a repeated order_id is split as well;
5. ids and UTM text are fetched last, for touches at the picked instants
   only (``touches_at``): no task sorts raw touches.

Frames that several branches read are written once to the shared folder
(``session.written``), at every size: there is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import day_ceiling, month_start
from revlens.operators.dedup import keep_one
from revlens.session import written

UNKNOWN = "Unknown"
INSTANT = ["contact_id", "ts", "touch_type"]
DETAIL_FIELDS = ["touch_id", "utm_source", "utm_medium", "utm_campaign"]
MONEY_SUM = "decimal(38,2)"
# A touch's share of an order, and sums of shares, in the UTM reports.
SHARE = "decimal(25,12)"


# --------------------------------------------------------------------------
# Sales side
# --------------------------------------------------------------------------

def won_sales(sales: DataFrame, opportunities: DataFrame, leads: DataFrame,
              dedupe_keys: bool = False) -> DataFrame:
    """Closed-won sales with their contact: order_id, sale_amount, booked_at, contact_id.

    Duplicate order, opportunity and lead ids fan out, as in the original
    (the duplicate-key checks report them).  ``dedupe_keys`` keeps one row
    per id first: the latest booking per order_id, the latest opportunity
    per opportunity_id, the latest lead per lead_id (ties by the remaining
    columns).
    """
    if dedupe_keys:
        sales = keep_one(sales, ["order_id"], "booked_at", descending=True)
        opportunities = keep_one(opportunities, ["opportunity_id"], "created_at", descending=True)
        leads = keep_one(leads, ["lead_id"], "created_at", descending=True)
    o = opportunities.where(F.col("win_flag") == 1).select("opportunity_id", "lead_id")
    lead = leads.select("lead_id", "contact_id")
    s = sales.select("order_id", "opportunity_id",
                     F.col("booked_amount").alias("sale_amount"), "booked_at")
    return (s.join(o, "opportunity_id").join(lead, "lead_id")
             .select("order_id", "sale_amount", "booked_at", "contact_id"))


def buyers(sales: DataFrame, opportunities: DataFrame, leads: DataFrame) -> DataFrame:
    """Distinct (contact, opportunity, order, amount, booked_at) of won sales."""
    o = opportunities.where(F.col("win_flag") == 1).select("opportunity_id", "lead_id")
    s = sales.select("order_id", "opportunity_id",
                     F.col("booked_amount").alias("sale_amount"), "booked_at")
    return (s.join(o, "opportunity_id").join(leads.select("lead_id", "contact_id"), "lead_id")
             .select("contact_id", "opportunity_id", "order_id", "sale_amount", "booked_at")
             .distinct())


def first_lead_date(leads: DataFrame) -> DataFrame:
    """Earliest lead created_at per contact."""
    return leads.groupBy("contact_id").agg(F.min("created_at").alias("first_lead_at"))


# --------------------------------------------------------------------------
# Touch state as of each booking day
# --------------------------------------------------------------------------

def _known(touches: DataFrame) -> DataFrame:
    return touches.where(F.col("contact_id").isNotNull() & F.col("ts").isNotNull())


def channel_days(touches: DataFrame) -> DataFrame:
    """(contact_id, day, touch_type) -> n, lo, hi: touches, first and last instant.

    Counts and instants have fixed width, so this first pass over the raw
    touches is a hash aggregate.
    """
    return _known(touches).groupBy("contact_id", day_ceiling("ts").alias("day"), "touch_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


def days(channel_day: DataFrame) -> DataFrame:
    """(contact_id, day) -> n, first_t, last_t from ``channel_days``: picks by instant, then channel."""
    pick = lambda ts: F.struct(F.col(ts).alias("ts"), F.col("touch_type"))
    return channel_day.groupBy("contact_id", "day").agg(
        F.sum("n").alias("n"), F.min(pick("lo")).alias("first_t"), F.max(pick("hi")).alias("last_t"))


def value_days(touches: DataFrame, field: str) -> DataFrame:
    """``channel_days`` for each value of ``field``: a hash aggregate as well."""
    return _known(touches).groupBy("contact_id", day_ceiling("ts").alias("day"), F.col(field).alias("value"), "touch_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


def touches_at(touches: DataFrame, instants: DataFrame, pick) -> DataFrame:
    """(contact_id, ts, touch_type, t): of the touches at each instant the first (``pick`` min) or last (max) by id and UTM text.

    ``instants`` holds distinct (contact_id, ts, touch_type).  Touches meet
    them in a hash join on all three, so none is sorted and a contact with
    many touches is spread; only touches that are left meet the aggregate
    over text.
    """
    t, k = _known(touches).select(*INSTANT, *DETAIL_FIELDS), instants.hint("shuffle_hash")
    same = (t["contact_id"] == k["contact_id"]) & (t["ts"] == k["ts"]) & t["touch_type"].eqNullSafe(k["touch_type"])
    return t.join(k, same, "left_semi").groupBy(*INSTANT).agg(pick(F.struct(*DETAIL_FIELDS)).alias("t"))


def booking_days(won: DataFrame) -> DataFrame:
    """Distinct (contact_id, day) booking days of won sales: the query points."""
    return (won.where(F.col("contact_id").isNotNull() & F.col("booked_at").isNotNull())
               .select("contact_id", F.col("booked_at").alias("day")).distinct())


def as_of(points: DataFrame, state: DataFrame, by: list[str], sums: list[str],
          mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """Running ``sums``, ``mins`` and ``maxs`` of ``state`` rows per ``by`` up to each point's day.

    Returns (by, day, aggregates) for the points with at least one state row
    on or before them.
    """
    values = [*sums, *mins, *maxs]
    blank = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in values]
    events = state.select(*by, "day", *values, F.lit(0).alias("is_q")).unionByName(
        points.select(*by, "day", *blank, F.lit(1).alias("is_q")))
    w = Window.partitionBy(*by).orderBy("day", "is_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picks = [(F.sum, sums), (F.min, mins), (F.max, maxs)]
    return (events.select(*by, "day", "is_q", *[f(c).over(w).alias(c) for f, cs in picks for c in cs])
                  .where((F.col("is_q") == 1) & F.col(values[0]).isNotNull()).drop("is_q"))


def _at_booking(won: DataFrame, state: DataFrame) -> DataFrame:
    w, s = won.alias("w"), state.alias("s")
    cond = (F.col("w.contact_id") == F.col("s.contact_id")) & (F.col("w.booked_at") == F.col("s.day"))
    return w.join(s, cond)


def touched_rows(won: DataFrame, day_state: DataFrame) -> DataFrame:
    """Won sales with at least one qualifying touch: their columns, n, first_t, last_t."""
    state = as_of(booking_days(won), day_state, ["contact_id"], ["n"], ["first_t"], ["last_t"])
    return _at_booking(won, state).select("w.*", "s.n", "s.first_t", "s.last_t")


def _pick(touch: str) -> Column:
    """What the first (min) or last (max) touch of an order_id is picked by."""
    return F.struct(F.col(f"{touch}.ts").alias("ts"), F.col(f"{touch}.touch_type").alias("touch_type"),
                    "sale_amount", "booked_at", "contact_id")


def order_touches(won: DataFrame, touches: DataFrame) -> DataFrame:
    """Touch path of each touched order, one row per order_id.

    order_id, sale_amount, booked_at, contact_id, touches_per_order,
    first_touch_ts, first_touch_type, last_touch_ts, last_touch_type.
    """
    won = written(won, "won_sales")       # query points + join back
    g = touched_rows(won, days(channel_days(touches))).groupBy("order_id").agg(
        F.sum("n").alias("touches_per_order"), F.min(_pick("first_t")).alias("f"), F.max(_pick("last_t")).alias("l"))
    return g.select("order_id", "f.sale_amount", "f.booked_at", "f.contact_id", "touches_per_order",
                    F.col("f.ts").alias("first_touch_ts"), F.col("f.touch_type").alias("first_touch_type"),
                    F.col("l.ts").alias("last_touch_ts"), F.col("l.touch_type").alias("last_touch_type"))


_SALE = ["p.sale_amount", "p.booked_at", "p.contact_id"]


def _with_fields(picked: DataFrame, touches: DataFrame, pick) -> DataFrame:
    """``picked`` rows (with a pick ``p``) and ``t``, the ids and UTM fields of the picked touches.

    The fields, a row per picked instant, are written: the join back has a
    shuffle on both sides, so an instant that many orders share is split.
    """
    picked = written(picked, "picked-touches")     # the instants + join back
    found = written(touches_at(touches, picked.select(*[f"p.{c}" for c in INSTANT]).distinct(), pick), "touch-fields")
    p, f = picked.alias("p0"), found.alias("f")
    same = (F.col("p.contact_id") == F.col("f.contact_id")) & (F.col("p.ts") == F.col("f.ts")) & F.col("p.touch_type").eqNullSafe(F.col("f.touch_type"))
    return p.join(f, same).select("p0.*", "f.t")


def _detail(g: DataFrame) -> DataFrame:
    return g.select("order_id", *_SALE, F.col("p.ts").alias("touch_ts"), "t.utm_source", "t.utm_medium", "t.utm_campaign",
                    "p.touch_type")


def _channel_detail(g: DataFrame) -> DataFrame:
    return g.select("order_id", *_SALE, F.col("p.ts").alias("touch_ts"), "p.touch_type")


def _first_rows(won: DataFrame, day_state: DataFrame) -> DataFrame:
    """Touched orders with their first touch.

    The first qualifying touch of an order, when there is one, is the
    contact's first touch overall, so a per-contact minimum (no window, no
    booking days) is enough: it qualifies when its day is on or before the
    booking day.  The minima, at most one row per contact, are written, so the
    join has a shuffle on both sides and AQE splits a contact with many sales;
    won sales are read once.
    """
    first = written(day_state.groupBy("contact_id").agg(F.min("first_t").alias("first_t"), F.min("day").alias("first_day")), "first-touches")
    w, f = won.alias("w"), first.alias("f")
    rows = w.join(f, (F.col("w.contact_id") == F.col("f.contact_id")) & (F.col("f.first_day") <= F.col("w.booked_at")))
    return rows.select("w.*", "f.first_t").groupBy("order_id").agg(F.min(_pick("first_t")).alias("p"))


def first_touch(won: DataFrame, touches: DataFrame) -> DataFrame:
    """Earliest qualifying touch per order, with its UTM fields."""
    return _detail(_with_fields(_first_rows(won, days(channel_days(touches))), touches, F.min))


def first_channel(won: DataFrame, touches: DataFrame) -> DataFrame:
    """``first_touch`` without UTM fields, for the channel reports."""
    return _channel_detail(_first_rows(won, days(channel_days(touches))))


def _last_rows(won: DataFrame, day_state: DataFrame) -> DataFrame:
    return touched_rows(won, day_state).groupBy("order_id").agg(F.max(_pick("last_t")).alias("p"))


def last_touch(won: DataFrame, touches: DataFrame) -> DataFrame:
    """Latest qualifying touch per order (an as-of lookup per booking day), with its UTM fields."""
    won = written(won, "won_sales")       # query points + join back
    return _detail(_with_fields(_last_rows(won, days(channel_days(touches))), touches, F.max))


def last_channel(won: DataFrame, touches: DataFrame) -> DataFrame:
    """``last_touch`` without UTM fields, for the channel reports."""
    won = written(won, "won_sales")       # query points + join back
    return _channel_detail(_last_rows(won, days(channel_days(touches))))


def _divisors(rows: DataFrame) -> DataFrame:
    """(order, touches_per_order, order_rows) per order_id, written: joins to it have a shuffle on both sides."""
    return written(rows.groupBy(F.col("order_id").alias("order")).agg(
        F.sum("n").alias("touches_per_order"), F.count(F.lit(1)).alias("order_rows")), "order-divisors")


def linear_touch(won: DataFrame, touches: DataFrame) -> DataFrame:
    """Linear credit per order and channel.

    order_id, sale_amount, booked_at, contact_id, touch_type, touches (of that
    channel), touches_per_order, attributed_revenue
    = sale_amount * touches / touches_per_order, which equals the sum of
    the per-touch shares ``sale_amount / touches_per_order``.

    A channel is counted at booking days from its first touch on, so there
    are no more query points than rows of the result.
    """
    won = written(won, "won_sales")       # query points + join back, twice
    per_channel = written(channel_days(touches), "channel-days")
    since = per_channel.groupBy("contact_id", "touch_type").agg(F.min("day").alias("since"))
    points = booking_days(won).join(since, "contact_id").where(F.col("since") <= F.col("day")).drop("since")
    # the channel is part of the window's key; a NULL channel is a group like any other
    state = as_of(points, per_channel, ["contact_id", "touch_type"], ["n"])
    rows = (_at_booking(won, state)
            .groupBy("w.order_id", "w.sale_amount", "w.booked_at", "w.contact_id", "s.touch_type")
            .agg(F.sum("s.n").alias("touches")))
    total = per_channel.groupBy("contact_id", "day").agg(F.sum("n").alias("n"))
    per_order = _divisors(_at_booking(won, as_of(booking_days(won), total, ["contact_id"], ["n"])).select("w.order_id", "s.n"))
    j = rows.join(per_order, rows["order_id"].eqNullSafe(per_order["order"]))
    return j.select("order_id", "sale_amount", "booked_at", "contact_id", "touch_type", "touches", "touches_per_order",
                    (F.col("sale_amount") * F.col("touches") / F.col("touches_per_order")).alias("attributed_revenue"))


# --------------------------------------------------------------------------
# Reports
# --------------------------------------------------------------------------

def _channel(c: str = "touch_type") -> Column:
    return F.coalesce(F.col(c), F.lit(UNKNOWN))


def single_touch_by_channel(detail: DataFrame) -> DataFrame:
    """channel, num_sales, total_revenue (first or last touch detail)."""
    return (detail.groupBy(_channel().alias("channel"))
                  .agg(F.count(F.lit(1)).alias("num_sales"),
                       F.sum("sale_amount").cast(MONEY_SUM).alias("total_revenue"))
                  .orderBy(F.desc_nulls_last("total_revenue")))


def linear_by_channel(linear: DataFrame) -> DataFrame:
    """channel, sales_touched, total_revenue_credit (rounded to cents)."""
    return (linear.groupBy(_channel().alias("channel"))
                  .agg(F.count_distinct("order_id").alias("sales_touched"),
                       F.round(F.sum("attributed_revenue"), 2).cast("decimal(18,2)")
                        .alias("total_revenue_credit"))
                  .orderBy(F.desc_nulls_last("total_revenue_credit")))


def single_touch_by_month(detail: DataFrame) -> DataFrame:
    """month_start, channel, customers_acquired, total_revenue.

    ``detail`` has one row per order_id, so counting order_id is the
    distinct count without a second aggregation pass.
    """
    return (detail.groupBy(month_start("booked_at").alias("month_start"), _channel().alias("channel"))
                  .agg(F.count("order_id").alias("customers_acquired"),
                       F.sum("sale_amount").cast(MONEY_SUM).alias("total_revenue"))
                  .orderBy("month_start", "channel"))


def linear_by_month(linear: DataFrame) -> DataFrame:
    """month_start, channel, customers_touched, total_revenue_credit (not rounded)."""
    return (linear.groupBy(month_start("booked_at").alias("month_start"), _channel().alias("channel"))
                  .agg(F.count_distinct("order_id").alias("customers_touched"),
                       F.sum("attributed_revenue").alias("total_revenue_credit"))
                  .orderBy("month_start", "channel"))


def _linear_credit(rows: DataFrame, per_value: DataFrame) -> DataFrame:
    """value, orders, revenue: linear credit of each touch value with a qualifying order.

    ``rows``: touched sales with n, their touches; ``per_value``: (contact_id,
    day, value, n), both written.  No booking day is paired with a value: each
    touch on day d earns, from every order its contact books on day D >= d,
    that order's share (sale_amount / touches_per_order, 12 decimals).  So the
    shares are summed per (contact, booking day), summed again over that and
    all later booking days, and each (contact, day, value, n) row earns n
    times the sum from its day on.  Orders touched by a value are counted the
    same way from the value's first day; order_ids on several rows are counted
    apart, as distinct (order_id, value).
    """
    per_order = _divisors(rows)
    shared = rows.join(per_order, rows["order_id"].eqNullSafe(per_order["order"]))
    shared = shared.withColumn("share", (F.col("sale_amount") / F.col("touches_per_order")).cast(SHARE))
    shared = written(shared.select("order_id", "contact_id", "booked_at", "order_rows", "share"), "order-shares")     # read twice
    booked = shared.groupBy("contact_id", F.col("booked_at").alias("day")).agg(
        F.sum("share").cast(SHARE).alias("share"),
        F.count_if((F.col("order_rows") == 1) & F.col("order_id").isNotNull()).alias("orders"), F.lit(1).alias("books"))
    touch_day = per_value.select("contact_id", "day").distinct()
    marks = booked.unionByName(touch_day.select("contact_id", "day", F.lit(None).cast(SHARE).alias("share"),
                                                F.lit(0).cast("bigint").alias("orders"), F.lit(0).alias("books")))
    onward = Window.partitionBy("contact_id").orderBy(F.desc("day"), F.desc("books")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earns = marks.select("contact_id", "day", "books", F.sum("share").over(onward).cast(SHARE).alias("share"),
                         F.sum("orders").over(onward).alias("orders"),
                         F.sum("books").over(onward).alias("ahead")).where("books = 0 AND ahead > 0").drop("books", "ahead")

    # each day's touches earn shares; a value's first day also earns the orders from then on
    since = written(per_value.groupBy("contact_id", "value").agg(F.min("day").alias("day")), "value-first-days")       # read twice
    earning = per_value.select("contact_id", "day", "value", "n", F.lit(0).alias("opens")).unionByName(
        since.select("contact_id", "day", "value", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("opens")))
    earned = earning.join(earns, ["contact_id", "day"]).groupBy("value").agg(
        F.sum(F.col("n").cast("decimal(12,0)") * F.col("share")).alias("credit"), F.sum(F.col("orders") * F.col("opens")).alias("orders"))
    several = shared.where((F.col("order_rows") > 1) & F.col("order_id").isNotNull()).groupBy("order_id", "contact_id").agg(F.max("booked_at").alias("until"))
    again = several.join(since, "contact_id").where(F.col("day") <= F.col("until")).select("order_id", "value").distinct()
    again = again.groupBy("value").agg(F.count(F.lit(1)).alias("orders"))
    return (earned.unionByName(again, allowMissingColumns=True).groupBy("value")
            .agg(F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("orders"), F.sum("credit").alias("revenue")))


def linear_credit_by_channel(won: DataFrame, touches: DataFrame) -> DataFrame:
    """``linear_by_channel`` of ``linear_touch`` without its rows per (order, channel).

    channel, sales_touched, total_revenue_credit.  Shares have 12 decimals a
    touch here and 9 an order and channel there; both are rounded to cents.
    """
    won = written(won, "won_sales")       # query points + join back
    per_channel = written(channel_days(touches), "channel-days")
    total = per_channel.groupBy("contact_id", "day").agg(F.sum("n").alias("n"))
    state = as_of(booking_days(won), total, ["contact_id"], ["n"])
    rows = written(_at_booking(won, state).select("w.*", "s.n"), "touched-orders")
    channel_day = per_channel.select("contact_id", "day", _channel().alias("value"), "n")
    return (_linear_credit(rows, channel_day)
            .select(F.col("value").alias("channel"), F.col("orders").alias("sales_touched"),
                    F.round("revenue", 2).cast("decimal(18,2)").alias("total_revenue_credit"))
            .orderBy(F.desc_nulls_last("total_revenue_credit")))


def attribution_by(won: DataFrame, touches: DataFrame, field: str) -> DataFrame:
    """All three models keyed by a touch field (utm_medium, utm_campaign, ...).

    model, <field>, orders, revenue (rounded to cents; NULL field -> 'Unknown').

    First and last touch group their picked touches by the field, which is
    fetched for these alone.  Linear credit: ``_linear_credit``.
    """
    won = written(won, "won_sales")       # query points + join back
    per_value = written(value_days(touches, field), "touch-value-days")
    rows = written(touched_rows(won, days(per_value)), "touched-orders")

    single = None
    for model, touch, pick in (("first", "first_t", F.min), ("last", "last_t", F.max)):
        picked = _with_fields(rows.groupBy("order_id").agg(pick(_pick(touch)).alias("p")), touches, pick)
        sums = picked.groupBy(F.col(f"t.{field}").alias("value")).agg(
            F.count(F.lit(1)).alias("orders"), F.sum("p.sale_amount").cast(MONEY_SUM).alias("revenue")).withColumn("model", F.lit(model))
        single = sums if single is None else single.unionByName(sums)

    linear = (_linear_credit(rows.drop("first_t", "last_t"), per_value)
              .select(F.lit("linear").alias("model"), "value", "orders", F.coalesce("revenue", F.lit(0)).alias("revenue")))
    every = single.unionByName(linear).groupBy("model", _channel("value").alias(field)).agg(
        F.sum("orders").alias("orders"), F.round(F.sum("revenue"), 2).cast(MONEY_SUM).alias("revenue"))
    return (every.where(F.col("orders") > 0).select("model", field, "orders", "revenue")
                 .orderBy("model", F.desc_nulls_last("revenue")))


def untouched_orders(won: DataFrame, touches: DataFrame) -> DataFrame:
    """Won sales whose order_id has no qualifying touch (anti join)."""
    won = written(won, "won_sales")       # joined to first days and anti-joined
    first = written(_known(touches).groupBy("contact_id").agg(F.min(day_ceiling("ts")).alias("first_day")), "first-days")
    w, f = won.alias("w"), first.alias("f")
    rows = w.join(f, (F.col("w.contact_id") == F.col("f.contact_id")) & (F.col("f.first_day") <= F.col("w.booked_at")))
    touched = written(rows.select("w.order_id").distinct(), "touched-order-ids")
    return won.join(touched, "order_id", "left_anti")


def qa_untouched(won: DataFrame, touches: DataFrame) -> DataFrame:
    """orders_with_no_touches, revenue_with_no_touches."""
    u = untouched_orders(won, touches)
    return u.agg(F.count_distinct("order_id").alias("orders_with_no_touches"),
                 F.sum("sale_amount").cast(MONEY_SUM).alias("revenue_with_no_touches"))


def qa_reconcile(sales: DataFrame, opportunities: DataFrame, won: DataFrame) -> DataFrame:
    """total_won_revenue (sales x won opportunities, no lead needed),
    total_won_orders and revenue_in_attribution (won sales with a contact)."""
    o = opportunities.where(F.col("win_flag") == 1).select("opportunity_id")
    truth = sales.join(o, "opportunity_id").agg(
        F.sum("booked_amount").cast(MONEY_SUM).alias("total_won_revenue"))
    entering = won.agg(F.struct(
        F.count_distinct("order_id").alias("orders"),
        F.sum("sale_amount").cast(MONEY_SUM).alias("revenue"))).scalar()   # scalar subquery
    return truth.select("total_won_revenue", entering["orders"].alias("total_won_orders"),
                        entering["revenue"].alias("revenue_in_attribution"))
