"""Property tests: on random small CRM data the pair-free attribution equals
the plain-Python evaluation of every (order, touch) pair."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from revlens.operators import attribution as A
from revlens.operators import influence as INF
from revlens.operators.touches import touches_from
from tests import brute
from tests.fixtures import frame

CHANNELS = [None, "paid", "organic", "email"]
BASE = dt.datetime(2024, 1, 1)

web_row = st.tuples(st.integers(1, 4), st.integers(0, 20), st.sampled_from([0, 0, 9, 23]),
                    st.sampled_from(CHANNELS), st.sampled_from([None, 1, 2]),
                    st.sampled_from([None, "c1", "c2", "c3"]))
email_row = st.tuples(st.integers(1, 4), st.integers(0, 20))
act_row = st.tuples(st.integers(1, 4), st.integers(0, 20),
                    st.sampled_from([None, "no_answer", "connected"]))
sale_row = st.tuples(st.integers(1, 6), st.integers(1, 5), st.integers(0, 20),
                     st.integers(1, 99999), st.sampled_from([0, 1, 1, 1]))


def _tables(spark, webs, emails, acts, sales):
    web = [(c, BASE + dt.timedelta(days=d, hours=h), ch, camp, "src", "cpc", utm, 1000 + i)
           for i, (c, d, h, ch, camp, utm) in enumerate(webs)]
    email = [(c, (BASE + dt.timedelta(days=d)).date(), "nl", "email", "c2", 2000 + i)
             for i, (c, d) in enumerate(emails)]
    act = [(3000 + i, c, (BASE + dt.timedelta(days=d)).date(), "call", o)
           for i, (c, d, o) in enumerate(acts)]
    # one opportunity and lead per sales row; an order id may repeat, also
    # within a contact
    leads, opps, sls = [], [], []
    for i, (order, contact, d, cents, win) in enumerate(sales):
        day = (BASE + dt.timedelta(days=d)).date()
        amount = Decimal(cents) / 100
        leads.append((100 + i, contact, "web", day, None, 1, 1))
        opps.append((500 + i, 100 + i, "s", amount, day, None, win))
        sls.append((order, 500 + i, amount, day))
    return {"web_sessions_stg": frame(spark, "web_sessions_stg", web),
            "email_engagement_stg": frame(spark, "email_engagement_stg", email),
            "sales_activities_stg": frame(spark, "sales_activities_stg", act),
            "leads_stg": frame(spark, "leads_stg", leads),
            "opportunities_stg": frame(spark, "opportunities_stg", opps),
            "sales_stg": frame(spark, "sales_stg", sls)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(webs=st.lists(web_row, min_size=1, max_size=12), emails=st.lists(email_row, max_size=6),
       acts=st.lists(act_row, max_size=6), sales=st.lists(sale_row, min_size=1, max_size=8))
def test_pair_free_equals_pair_join(spark, webs, emails, acts, sales):
    tables = _tables(spark, webs, emails, acts, sales)
    held = brute.collect(tables)
    won = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"])
    t = touches_from(tables)
    assert brute.rows(A.single_touch_by_channel(A.first_channel(won, t))) == brute.rows(brute.single(held, last=False))
    assert brute.rows(A.single_touch_by_channel(A.last_channel(won, t))) == brute.rows(brute.single(held, last=True))
    assert brute.rows(A.linear_by_channel(A.linear_touch(won, t))) == brute.rows(brute.linear(held))
    assert brute.rows(A.linear_credit_by_channel(won, t)) == brute.rows(brute.linear(held))
    assert brute.rows(A.qa_untouched(won, t)) == brute.rows(brute.untouched(held))
    assert brute.rows(INF.customer_influence(won, t)) == brute.rows(brute.customer_influence(held))
    by_campaign = [(m, *r) for m, rs in (("first", brute.single(held, False, "campaign")), ("last", brute.single(held, True, "campaign")),
                                         ("linear", brute.linear(held, "campaign"))) for r in rs]
    assert brute.rows(A.attribution_by(won, t, "utm_campaign")) == brute.rows(by_campaign)


lead_row = st.tuples(st.integers(1, 6), st.sampled_from([None, "web", "ads"]), st.integers(0, 40),
                     st.sampled_from([None, 0, 1]), st.sampled_from([None, 0, 1]))
opp_row = st.tuples(st.integers(1, 6), st.integers(1, 7), st.integers(0, 99999), st.sampled_from([None, 0, 1]))
sale_of_opp = st.tuples(st.integers(1, 6), st.integers(0, 99999))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(leads=st.lists(lead_row, min_size=1, max_size=8), opps=st.lists(opp_row, max_size=8),
       sales=st.lists(sale_of_opp, max_size=6))
def test_funnel_equals_literal(spark, leads, opps, sales):
    """Random leads (NULL sources and flags, repeated ids), opportunities
    (repeated ids, unknown leads) and sales: the one-aggregate funnel equals
    the plain-Python count."""
    from revlens.operators import funnel as FN
    day = BASE.date()
    L = frame(spark, "leads_stg", [(i, 1, src, day + dt.timedelta(days=d), None, m, q)
                                    for (i, src, d, m, q) in leads])
    O = frame(spark, "opportunities_stg", [(o, l, "s", Decimal(c) / 100, day, None, w) for (o, l, c, w) in opps])
    S = frame(spark, "sales_stg", [(k, o, Decimal(c) / 100, day) for k, (o, c) in enumerate(sales)])
    held = brute.collect({"leads_stg": L, "opportunities_stg": O, "sales_stg": S})
    assert brute.rows(FN.lead_funnel(L, O, S)) == brute.rows(brute.lead_funnel(held))


dedup_row = st.tuples(st.integers(1, 4), st.sampled_from([None, 1, 2, 3]), st.integers(1, 3),
                      st.sampled_from([None, "a", "b"]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(dedup_row, min_size=1, max_size=14), descending=st.booleans())
def test_keep_one_equals_row_number(spark, rows, descending):
    """keep_one (a struct min/max aggregate) picks the row ROW_NUMBER() = 1
    picks, with NULLs first ascending and last descending, ties broken by the
    remaining columns; the preview is exactly the other rows."""
    from revlens.operators import quality as Q
    from revlens.operators.dedup import keep_one
    df = spark.createDataFrame(rows, "k long, o long, t long, s string")
    df.createOrReplaceTempView("kv")
    d = "DESC NULLS LAST" if descending else "ASC NULLS FIRST"
    literal = spark.sql(f"""SELECT k, o, t, s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k
        ORDER BY o {d}, t {d}, s {d}) AS rn FROM kv) WHERE rn = 1""")
    kept = keep_one(df, ["k"], "o", descending=descending, tie_break=["t"])
    assert brute.rows(kept) == brute.rows(literal)
    removed = Q.dedup_preview(df, ["k"], "o", descending=descending, tie_break=["t"])
    assert removed.count() == df.count() - kept.count()
