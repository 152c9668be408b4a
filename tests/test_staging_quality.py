"""Staging pipelines and data-quality operators on dirty mini fixtures."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from revlens.operators import quality as Q
from revlens.operators import staging as STG
from revlens.operators.dedup import keep_one

D, T = dt.date, dt.datetime


def contacts_dirty(spark):
    return spark.createDataFrame([
        (1, "  Ann@Example.COM ", "2024-01-05", "web", 1),
        (1, "ann [at] example.com", "01/07/2024", "web", 2),       # latest: kept
        (2, "bob[at]example.com", "2024-01-02", "ads", 3),          # no spaces around [at]: unchanged
        (3, "\tcid@example.com", "2024-13-45", "ads", 4),           # tab kept; unparseable date
        (4, "dee@example.org", "2024-01-01", "web", 5),
        (5, None, "2024-01-01", "web", 6),
        (6, "eve@example.com", "2024-01-03", "web", 7),
        (6, "eve2@example.com", "2024-01-03", "web", 8),            # same date: rid breaks the tie
    ], "contact_id long, email string, created_at string, lead_source string, rid long")


def test_clean_contacts(spark):
    c = {r.rid: r for r in STG.clean_contacts(contacts_dirty(spark)).collect()}
    assert c[1].email == "ann@example.com"
    assert c[2].email == "ann@example.com" and c[2].created_at == D(2024, 1, 7)
    assert c[3].email == "bob[at]example.com"
    assert c[4].email == "\tcid@example.com" and c[4].created_at is None
    assert "contact_source" in STG.clean_contacts(contacts_dirty(spark)).columns


def test_stage_contacts_keeps_latest(spark):
    got = {r.contact_id: r.rid for r in STG.stage_contacts(contacts_dirty(spark)).collect()}
    assert got == {1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 8}


def test_invalid_emails_and_rejects(spark):
    raw = contacts_dirty(spark)
    bad = {r.rid for r in Q.invalid_emails(STG.clean_contacts(raw)).collect()}
    assert bad == {3, 5, 6}                   # [at] without spaces, .org, NULL
    rej = Q.rejects(raw, STG.conversions("crm_contacts", raw)).collect()
    assert [(r.column, r.rejected) for r in rej] == [("created_at", 1)]


def leads_dirty(spark):
    return spark.createDataFrame([
        (1, 10, T(2024, 1, 1, 9), None),                    # NULL response: kept (NULL sorts first)
        (1, 10, T(2024, 1, 1, 9), T(2024, 1, 2, 8)),
        (2, 11, T(2024, 1, 1, 9), T(2024, 1, 3, 17)),
        (2, 11, T(2024, 1, 1, 9), T(2024, 1, 3, 9)),        # same day, earlier time: kept
        (3, 12, T(2024, 1, 1, 9), T(2024, 1, 3, 9)),
    ], "lead_id long, contact_id long, created_at timestamp_ntz, first_response_at timestamp_ntz")


def test_stage_leads(spark):
    raw = leads_dirty(spark)
    got = {r.lead_id: r for r in STG.stage_leads(raw).collect()}
    assert got[1].first_response_at is None
    assert got[2].first_response_at == D(2024, 1, 3)
    assert got[2].created_at == D(2024, 1, 1)
    assert len(got) == 3
    removed = Q.dedup_preview(raw, ["lead_id"], "first_response_at", descending=False).collect()
    assert sorted((r.lead_id, r.first_response_at) for r in removed) == [
        (1, T(2024, 1, 2, 8)), (2, T(2024, 1, 3, 17))]


def test_duplicate_rows(spark):
    dups = Q.duplicate_rows(leads_dirty(spark), ["lead_id"]).collect()
    assert sorted({r.lead_id for r in dups}) == [1, 2] and len(dups) == 4


def test_keep_one_matches_row_number(spark):
    df = leads_dirty(spark)
    df.createOrReplaceTempView("leads_dirty")
    literal = spark.sql("""SELECT lead_id, contact_id, created_at, first_response_at FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY first_response_at,
            contact_id, created_at) AS rn FROM leads_dirty) WHERE rn = 1""")
    ours = keep_one(df, ["lead_id"], "first_response_at", descending=False)
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(map(tuple, literal.collect()), key=repr)


def test_stage_accounts(spark):
    raw = spark.createDataFrame([
        (1, "  Acme  Corp ", "  SaaS ", "1-10", " EMEA ", 10.125, "Basic "),
        (1, "Acme Corp", "saas", "1-10", "emea", 99999999999.0, " Pro"),   # duplicate id; MRR too large
    ], "account_id long, account_name string, industry string, employee_bucket string, region string, "
       "current_mrr double, plan string")
    rows = STG.stage_accounts(raw).collect()
    assert rows[0].account_name == "acme__corp" and rows[0].industry == "saas"
    assert rows[0].region == "emea" and rows[0].subscription_plan == "basic"
    assert rows[0].current_mrr == Decimal("10.13")          # half up
    assert rows[1].current_mrr is None                      # beyond DECIMAL(10,2): NULL
    assert len(Q.duplicate_rows(raw, ["account_id"]).collect()) == 2   # reported, kept


def test_stage_abm_and_money(spark):
    abm = spark.createDataFrame([(1, " High Value ", "tier_1")], "account_id long, target_reason string, abm_tier string")
    assert STG.stage_abm_accounts(abm).collect()[0].target_reason == "high_value"
    spend = spark.createDataFrame([("2024-01-01", "paid", "12.345"), ("2024-01-01", "paid", "abc")],
                                  "month_start string, channel string, spend string")
    got = [r.spend for r in STG.stage_spend(spend).collect()]
    assert got == [Decimal("12.35"), None]


def test_profile_and_domains(spark):
    raw = leads_dirty(spark)
    prof = {r.column: r for r in Q.profile(raw, "leads", ["lead_id"]).collect()}
    assert prof["first_response_at"].nulls == 1 and prof["lead_id"].rows == 5
    assert prof["lead_id"].is_key is True
    dv = {r.value: r.rows for r in Q.domain_values(raw, "contact_id").collect()}
    assert dv == {"10": 2, "11": 2, "12": 1}
    assert Q.domain_values(raw, "contact_id", "lead_id").count() == 6
    assert Q.distinct_count(raw, "lead_id").collect()[0][0] == 3
    assert Q.lookup_key(raw, "lead_id", 2).count() == 2
    assert Q.data_dictionary(spark).where(F.col("declared_key")).count() >= 5


def test_duplicate_rows_hot_key(spark):
    """A key with half of all rows; NULL keys never match.  The semi join has
    a shuffle on both sides, so AQE can split the hot key."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7))                      # hot key: 2,000 rows
         .when(F.col("id") % 11 == 1, F.lit(None))                  # NULL keys, repeated
         .otherwise(F.col("id") % 500).cast("bigint").alias("k"),   # other repeats and singles
        F.col("id").alias("v"))
    held = [tuple(r) for r in df.collect()]
    count = {}
    for k, _ in held:
        count[k] = count.get(k, 0) + 1
    want = sorted(r for r in held if r[0] is not None and count[r[0]] > 1)
    ours = Q.duplicate_rows(df, ["k"])
    assert sorted(map(tuple, ours.collect())) == want
    check = Q.duplicate_keys({"df.k": (df, ["k"])}).collect()[0]
    assert (check["check"], check["repeated_keys"], check["rows"]) == ("df.k", len({k for k, _ in want}), len(want))


def test_rejects_count_rows_without_a_key_and_repeated_keys(spark):
    raw = spark.createDataFrame([(None, "bad", "1"), (1, "bad", "x"), (1, "2024-01-01", "2.5"), (2, None, "999999999999")],
                                "contact_id long, created_at string, spend string")
    got = {(r.table, r.column): r.rejected for r in Q.table_rejects({
        "crm_contacts": (raw, STG.conversions("crm_contacts", raw)), "spend": (raw, STG.conversions("spend", raw))}).collect()}
    assert got == {("crm_contacts", "created_at"): 2, ("spend", "spend"): 2}


def test_profile_takes_any_column_name(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], ["it's", "a`b"])
    got = {r.column: (r.nulls, r.min, r.max) for r in Q.profile(df, "t'able", estimate_distinct=True).collect()}
    assert got == {"it's": (1, "1", "1"), "a`b": (0, "a", "b")}
