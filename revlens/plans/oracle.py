"""DuckDB SQL for the registered queries, written from the definitions.

Each statement rebuilds the CRM rows it needs from the driver's tables and
computes the result in a shape of its own, other than the Spark plans': touches
come from one pass over the events, an order's picks are ``arg_min`` and
``arg_max`` over a text key, duplicates go through ``DISTINCT ON``, influence
asks EXISTS per channel, the funnel sums a per-lead table, and monthly reports
use scalar subqueries.

Dialect notes: DuckDB divides decimals as DOUBLE, so ratios that a report
rounds are done in integers here (half up); it sorts NULL last both ways, so
orders name the place of NULL.
"""

from __future__ import annotations


# --------------------------------------------------------------------------
# helpers
# --------------------------------------------------------------------------

def _scaled(int_expr: str, scale: int) -> str:
    """Integer count of 10^-scale units -> exact DECIMAL(38, scale)."""
    unit = f"{10 ** -scale:.{scale}f}"
    return f"(CAST({int_expr} AS DECIMAL(28,0)) * CAST({unit} AS DECIMAL({scale + 1},{scale})))"


def _half_up(num: str, den: str) -> str:
    """num / den of two integers, rounded half up."""
    return f"((2 * ({num}) + ({den})) // (2 * ({den})))"


def _ratio(num: str, den: str, scale: int, num_scale: int = 0, den_scale: int = 0, out: str | None = None) -> str:
    """num / den to ``scale`` places, half up; NULL when den is 0 or NULL.

    ``num`` and ``den`` are decimals with ``num_scale`` and ``den_scale`` places.
    """
    n = f"CAST(({num}) * {10 ** num_scale} AS HUGEINT) * {10 ** (den_scale + scale)}"
    d = f"CAST(({den}) * {10 ** den_scale} AS HUGEINT) * {10 ** num_scale}"
    return f"CAST(CASE WHEN ({den}) <> 0 THEN {_scaled(_half_up(n, d), scale)} END AS {out or f'DECIMAL(18,{scale})'})"


def _cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(38,2))"


def _month(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS DATE)"


def _choice(values: list, idx: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"CAST([{listed}][1 + CAST({idx} AS INTEGER)] AS VARCHAR)"


_DAY = ("CAST(DATE '2024-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 90 AS INTEGER) AS DATE)")
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_MEDIUM = _choice(["cpc", "social", "referral", None], f"{_K} % 4")
_UTM = f"""CASE WHEN event_id % 6 = 0 THEN ' ' || upper({_MEDIUM}) || ' ' ELSE {_MEDIUM} END AS utm_medium,
        'cmp_' || ({_K} % 10) AS utm_campaign"""
_PARSED = "COALESCE(TRY_CAST(created_at AS DATE), CAST(try_strptime(created_at, '%m/%d/%Y') AS DATE))"


# --------------------------------------------------------------------------
# CRM rows
# --------------------------------------------------------------------------

CTES: dict[str, str] = {
    "twice": "SELECT unnest([0, 1]) AS copy",
    "raw_lead": f"""SELECT 'LED' || o_orderkey AS lead_id,
            CASE WHEN o_orderkey % 101 <> 0 THEN 'CON' || o_custkey END AS contact_id,
            if(copy = 1, 'import', o_orderpriority) AS source,
            if(o_orderkey % 211 = 0, 'n/a', strftime({_DAY}, '%Y-%m-%d')) AS created_at,
            CASE WHEN copy = 1 OR o_orderkey % 7 <> 0
                 THEN CAST({_DAY} AS TIMESTAMP) + to_hours(CASE WHEN copy = 0 THEN 8 WHEN o_orderkey % 10 = 0 THEN 5 ELSE 11 END)
            END AS first_response_at,
            CAST(o_orderstatus <> 'O' AS INTEGER) AS mql_flag, CAST(o_orderstatus = 'F' AS INTEGER) AS sql_flag
        FROM orders, twice WHERE copy = 0 OR o_orderkey % 5 = 0""",
    "lead": """SELECT DISTINCT ON (lead_id) lead_id, contact_id, source, TRY_CAST(created_at AS DATE) AS created_at,
            CAST(first_response_at AS DATE) AS first_response_at, mql_flag, sql_flag
        FROM raw_lead ORDER BY lead_id, raw_lead.first_response_at NULLS FIRST""",
    "opp": f"""SELECT 'OPP' || o_orderkey AS opportunity_id, if(o_orderkey % 37 = 0, 'GONE' || o_orderkey, 'LED' || (o_orderkey - CAST(o_orderkey % 4 = 1 AS INTEGER))) AS lead_id,
            o_orderstatus AS stage, CAST(CAST(o_totalprice AS DECIMAL(10,2)) + copy AS DECIMAL(10,2)) AS amount, {_DAY} AS created_at,
            CASE WHEN o_orderkey % 59 <> 0 THEN CAST({_DAY} + 14 AS DATE) END AS close_date,
            CAST(o_orderstatus = 'F' AS INTEGER) AS win_flag
        FROM orders, twice WHERE o_orderstatus <> 'O' AND (copy = 0 OR o_orderkey % 17 = 0)""",
    "sale": f"""SELECT 'ORD' || o_orderkey || if(copy = 1 AND o_orderkey % 11 = 0, '-2', '') AS order_id, 'OPP' || o_orderkey AS opportunity_id,
            CAST(CAST(o_totalprice AS DECIMAL(10,2)) + 10 * copy AS DECIMAL(10,2)) AS booked_amount, CAST({_DAY} + 3 * copy AS DATE) AS booked_at
        FROM orders, twice WHERE o_orderstatus = 'F' AND (copy = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)""",
    "session": f"""SELECT CASE WHEN event_id % 97 <> 0 THEN 'CON' || user_id END AS contact_id, ts AS started_at,
            CASE WHEN event_id % 19 <> 0 THEN if(event_type = 'view', 'organic', 'paid') END AS channel,
            CASE WHEN {_K} < 80 THEN 'CMP' || {_K} END AS campaign_id, 'web' AS utm_source, {_UTM}, CAST(event_id AS VARCHAR) AS touch_id
        FROM events WHERE event_type IN ('view', 'click')""",
    "mail": f"""SELECT 'CON' || user_id AS contact_id, CASE WHEN event_id % 53 <> 0 THEN CAST(ts AS DATE) END AS sent_at,
            'email' AS utm_source, {_UTM}, CAST(event_id AS VARCHAR) AS touch_id
        FROM events WHERE event_type = 'signup'""",
    "activity": """SELECT 'ACT' || event_id AS activity_id, 'CON' || user_id AS contact_id, CAST(ts AS DATE) AS ts, event_type AS type,
            CASE WHEN event_type = 'error' THEN 'no_answer' WHEN event_id % 29 <> 0 THEN 'connected' END AS outcome
        FROM events WHERE event_type IN ('purchase', 'error')""",
    # one pass over the events: which of them are touches, and of which kind
    "touch": f"""SELECT CASE WHEN kind <> 'web' OR event_id % 97 <> 0 THEN 'CON' || user_id END AS contact_id,
            CASE kind WHEN 'web' THEN ts WHEN 'email' THEN if(event_id % 53 = 0, NULL, date_trunc('day', ts)) ELSE date_trunc('day', ts) END AS ts,
            CASE WHEN kind <> 'web' THEN kind WHEN event_id % 19 <> 0 THEN if(event_type = 'view', 'organic', 'paid') END AS touch_type,
            CASE WHEN kind = 'sales' THEN event_type END AS source_label,
            CASE WHEN kind = 'web' THEN 'CMP' || {_K} END AS campaign_id,
            CASE WHEN kind <> 'sales' THEN kind END AS utm_source,
            CASE WHEN kind <> 'sales' THEN if(event_id % 6 = 0, ' ' || upper({_MEDIUM}) || ' ', {_MEDIUM}) END AS utm_medium,
            CASE WHEN kind <> 'sales' THEN 'cmp_' || ({_K} % 10) END AS utm_campaign,
            if(kind = 'sales', 'ACT', '') || event_id AS touch_id
        FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') AND {_K} < 80 THEN 'web' WHEN event_type = 'signup' THEN 'email'
                             WHEN event_type = 'purchase' AND event_id % 29 <> 0 THEN 'sales' END AS kind FROM events)
        WHERE kind IS NOT NULL""",
    "won": """SELECT order_id, booked_amount AS sale_amount, booked_at, contact_id, opportunity_id
        FROM (FROM opp WHERE win_flag = 1) JOIN sale USING (opportunity_id) JOIN lead USING (lead_id)""",
    # every order row with every touch it may claim, and a text that sorts them
    "claim": """SELECT won.order_id, won.sale_amount, won.booked_at, won.contact_id, touch.ts AS touch_ts, touch.touch_type, touch.utm_source,
            touch.utm_medium, touch.utm_campaign,
            concat_ws(chr(1), strftime(touch.ts, '%Y%m%d%H%M%S%f'), coalesce('~' || touch.touch_type, ''),
                      lpad(CAST(CAST(won.sale_amount * 100 AS BIGINT) AS VARCHAR), 15, '0'), won.booked_at, won.contact_id, touch.touch_id) AS place
        FROM touch JOIN won ON touch.contact_id = won.contact_id WHERE touch.ts <= won.booked_at""",
    "path": """SELECT order_id, count(*) AS n, arg_min(claim, place) AS head, arg_max(claim, place) AS tail FROM claim GROUP BY order_id""",
    "account": f"""SELECT 'ACC' || c_custkey AS account_id, replace(lower(trim(replace(c_name, '#', ' '))), ' ', '_') AS account_name,
            lower(c_mktsegment) AS industry, {_choice(["1-10", "11-50", "51-200", "201+"], "c_custkey % 4")} AS employee_bucket,
            lower(r_name) AS region, TRY_CAST(if(c_custkey % 47 = 0, 1e12, c_acctbal) AS DECIMAL(10,2)) AS current_mrr,
            {_choice(["basic", "pro", "enterprise"], "c_nationkey % 3")} AS subscription_plan
        FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "abm": f"""SELECT 'ACC' || s_suppkey AS account_id, {_choice(["high_value", "expansion_fit"], "s_suppkey % 2")} AS target_reason,
            'tier_' || ((s_suppkey + copy) % 3 + 1) AS abm_tier
        FROM supplier, twice WHERE copy = 0 OR s_suppkey % 9 = 0""",
    "cost": f"""SELECT make_date(2024, CAST(p_size % 3 + 1 AS INTEGER), 1) AS month_start,
            {_choice(["email", "organic", "paid", "sales"], "p_partkey % 4")} AS channel,
            CASE WHEN p_partkey % 31 <> 0 AND p_partkey % 37 <> 0 THEN CAST(p_retailprice AS DECIMAL(10,2)) END AS spend
        FROM part""",
    "fee": """SELECT 'ACC' || o_custkey AS account_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS mrr,
            if(l_returnflag = 'R' AND l_discount >= 0.09, 'churned', 'active') AS status
        FROM lineitem, orders WHERE l_orderkey = o_orderkey""",
    "raw_contact": f"""SELECT 'CON' || o_custkey AS contact_id,
            CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ' User' || o_custkey || ' [at] Example.COM '
                 WHEN o_orderkey % 5 = 0 THEN 'user' || o_custkey || '@example.org' ELSE 'User' || o_custkey || '@example.com' END AS email,
            CASE WHEN o_orderkey % 29 = 0 THEN '2024-13-45' WHEN o_orderkey % 3 = 0 THEN strftime({_DAY}, '%m/%d/%Y')
                 ELSE strftime({_DAY}, '%Y-%m-%d') END AS created_at, o_orderpriority AS contact_source, o_orderkey AS rid
        FROM orders""",
    "contact": f"""SELECT contact_id, replace(lower(trim(email)), ' [at] ', '@') AS email, {_PARSED} AS created_at, contact_source, rid
        FROM raw_contact""",
    "lifetime": f"""SELECT account_id, count(*) AS lifetime_months, {_money("sum(mrr)")} AS total_ltv,
            if(count(*) FILTER (WHERE status = 'churned') > 0, 'churned', 'active') AS final_status FROM fee GROUP BY ALL""",
    "segment": """SELECT account_id, lifetime_months, total_ltv, final_status, industry, employee_bucket, region, subscription_plan,
            if(abm.abm_tier IS NULL, 'Non-ABM', 'ABM') AS abm_status, abm_tier
        FROM account JOIN lifetime USING (account_id) LEFT JOIN abm USING (account_id)""",
    "deal": """SELECT opportunity_id, amount, stage, opp_created_at, contact_id FROM lead
        JOIN (SELECT opportunity_id, amount, stage, created_at AS opp_created_at, lead_id FROM opp) USING (lead_id)""",
    "channel": "SELECT DISTINCT touch_type AS channel FROM touch",
    # what each lead brings to the funnel; an opportunity row counts once per sale it has, at least once
    "yield": """SELECT lead_id, count(DISTINCT opportunity_id) AS opps, count(DISTINCT opportunity_id) FILTER (WHERE win_flag = 1) AS wins,
            sum(amount * greatest(1, coalesce(n, 0))) AS pipeline, sum(booked) FILTER (WHERE win_flag = 1) AS revenue
        FROM opp LEFT JOIN (SELECT opportunity_id, count(*) AS n, sum(booked_amount) AS booked FROM sale GROUP BY ALL) USING (opportunity_id)
        GROUP BY lead_id""",
}

DEPS: dict[str, list[str]] = {
    "raw_lead": ["twice"], "lead": ["raw_lead"], "opp": ["twice"], "sale": ["twice"], "abm": ["twice"],
    "won": ["opp", "sale", "lead"], "claim": ["won", "touch"], "path": ["claim"], "contact": ["raw_contact"],
    "lifetime": ["fee"], "segment": ["account", "lifetime", "abm"], "deal": ["lead", "opp"], "channel": ["touch"], "yield": ["opp", "sale"],
}


def sql(uses: str, body: str) -> str:
    """WITH <the CTEs named in ``uses`` and what they need> <body>."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in uses.split():
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order) + f"\n{body}"


# --------------------------------------------------------------------------
# reports
# --------------------------------------------------------------------------

_DETAIL = ["sale_amount", "booked_at", "contact_id", "touch_ts", "utm_source", "utm_medium", "utm_campaign", "touch_type"]
_CREDIT = _scaled(_half_up(f"{_cents('sale_amount')} * count(*) * 10000000", "max(n)"), 9)
#: Credit of each (order row, channel).
_LINEAR = f"""SELECT order_id, sale_amount, booked_at, contact_id, touch_type, count(*) AS touches, max(n) AS touches_per_order,
        {_CREDIT} AS attributed_revenue FROM claim JOIN path USING (order_id)
    GROUP BY order_id, sale_amount, booked_at, contact_id, touch_type"""


def _detail(end: str) -> str:
    return f"SELECT order_id, {', '.join(f'{end}.{c} AS {c}' for c in _DETAIL)} FROM path"


def _named(c: str) -> str:
    return f"ifnull({c}, 'Unknown')"


def _single_by_channel(end: str) -> str:
    return sql("path", f"""SELECT {_named(f'{end}.touch_type')} AS channel, count(*) AS num_sales,
        {_money(f'sum({end}.sale_amount)')} AS total_revenue FROM path GROUP BY channel""")


def _by_month(end: str) -> str:
    return f"""SELECT {_month(f'{end}.booked_at')} AS month_start, {_named(f'{end}.touch_type')} AS channel,
        count(*) AS customers_acquired, {_money(f'sum({end}.sale_amount)')} AS total_revenue FROM path GROUP BY ALL"""


def _by_utm(field: str) -> str:
    share = _half_up(f"{_cents('sale_amount')} * 10000000000", "n")
    revenue = f"CAST({_scaled(_half_up('sum(share)', '10000000000'), 2)} AS DECIMAL(38,2))"
    ends = " UNION ALL ".join(f"""SELECT '{model}' AS model, {_named(f'{end}.{field}')} AS {field}, count(*) AS orders,
        {_money(f'sum({end}.sale_amount)')} AS revenue FROM path GROUP BY ALL""" for model, end in (("first", "head"), ("last", "tail")))
    return sql("path", f"""{ends} UNION ALL SELECT 'linear', v, count(DISTINCT order_id), {revenue}
        FROM (SELECT order_id, {_named(field)} AS v, {share} AS share FROM claim JOIN path USING (order_id)) GROUP BY v""")


def _influence(base: str, key: str, at: str, extra: str = "") -> str:
    """Records of ``base`` with a touch of a channel on or before their date, per channel."""
    return f"""SELECT DISTINCT channel, {key}{extra} FROM channel, {base} AS r WHERE EXISTS (
        FROM touch WHERE touch.contact_id = r.contact_id AND touch.touch_type IS NOT DISTINCT FROM channel AND touch.ts <= r.{at})"""


def _funnel(key: str, name: str) -> str:
    total = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
    return sql("lead yield", f"""SELECT {key} AS {name}, count(*) AS leads, {total('CAST(mql_flag = 1 AS INTEGER)')} AS mqls,
        {total('CAST(sql_flag = 1 AS INTEGER)')} AS sqls, {total('opps')} AS opps, {total('wins')} AS won_opps,
        {_money('sum(pipeline)')} AS pipeline_amount, {_money('sum(revenue)')} AS closed_won_revenue,
        {_ratio(total('opps'), 'count(*)', 4)} AS lead_to_opp_rate, {_ratio(total('wins'), total('opps'), 4)} AS opp_to_win_rate,
        {_ratio(total('wins'), 'count(*)', 4)} AS lead_to_win_rate
    FROM lead LEFT JOIN yield USING (lead_id) GROUP BY {key}""")


_LTV = f"""{_ratio('sum(total_ltv)', 'count(*)', 6, num_scale=2, out='DECIMAL(38,6)')} AS avg_ltv, avg(lifetime_months) AS avg_lifetime_months,
        CAST(count(*) FILTER (WHERE final_status = 'churned') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS churn_rate"""


def _overview() -> str:
    at = lambda what, table, day: f"(SELECT {what} FROM {table} WHERE {_month(day)} IS NOT DISTINCT FROM m)"
    win = "(SELECT * FROM sale WHERE opportunity_id IN (SELECT opportunity_id FROM opp WHERE win_flag = 1))"
    inner = f"""SELECT m AS month_start, {at('count(*)', 'lead', 'created_at')} AS leads, {at('count(*)', 'opp', 'created_at')} AS opportunities,
            {at('count(*) FILTER (WHERE win_flag = 1)', 'opp', 'created_at')} AS won_opps, {at('count(*)', win, 'booked_at')} AS won_sales,
            {at('sum(booked_amount)', win, 'booked_at')} AS revenue, {at('count(order_id)', 'sale', 'booked_at')} AS orders,
            {at('sum(spend)', 'cost', 'month_start')} AS spend
        FROM (SELECT {_month('created_at')} AS m FROM lead UNION SELECT {_month('created_at')} FROM opp
              UNION SELECT {_month('booked_at')} FROM sale UNION SELECT month_start FROM cost)"""
    return sql("lead opp sale cost", f"""SELECT month_start, leads, opportunities, won_opps, {_ratio('won_opps', 'opportunities', 4)} AS win_rate, won_sales,
        {_ratio('revenue', 'won_sales', 2, num_scale=2)} AS acv, {_money('revenue')} AS revenue, {_money('spend')} AS spend,
        {_ratio('spend', 'orders', 2, num_scale=2)} AS cac FROM ({inner})""")


_RAW_LEAD = "lead_id, contact_id, source, created_at, first_response_at, mql_flag, sql_flag"
_RAW_KEYS = {
    "abm_accounts.account_id": ("abm", "account_id"), "accounts.account_id": ("account", "account_id"),
    "crm_contacts.contact_id": ("raw_contact", "contact_id"), "leads.lead_id": ("raw_lead", "lead_id"),
    "opportunities.opportunity_id": ("opp", "opportunity_id"), "opportunities.lead_id": ("opp", "lead_id"),
    "sales.order_id": ("sale", "order_id"), "sales_activities.activity_id": ("activity", "activity_id"),
}

#: (table, column, driver rows with a value that does not convert)
_REJECTS = [
    ("crm_contacts", "created_at", "FROM orders WHERE o_orderkey % 29 = 0"),
    ("leads", "created_at", "FROM orders, twice WHERE o_orderkey % 211 = 0 AND (copy = 0 OR o_orderkey % 5 = 0)"),
    ("leads", "first_response_at", "FROM orders WHERE false"),
    ("opportunities", "created_at", "FROM orders WHERE false"),
    ("opportunities", "close_date", "FROM orders, twice WHERE o_orderstatus <> 'O' AND o_orderkey % 59 = 0 AND (copy = 0 OR o_orderkey % 17 = 0)"),
    ("sales", "booked_at", "FROM orders WHERE false"),
    ("sales_activities", "ts", "FROM events WHERE false"),
    ("email_engagement", "sent_at", "FROM events WHERE event_type = 'signup' AND event_id % 53 = 0"),
    ("content_engagement", "engaged_at", "FROM events WHERE event_id % 61 = 0"),
    ("accounts", "current_mrr", "FROM customer WHERE c_custkey % 47 = 0"),
    ("spend", "spend", "FROM part WHERE p_partkey % 31 = 0 OR p_partkey % 37 = 0"),
    ("seo_search_console", "avg_position", "FROM part WHERE p_partkey % 43 = 0"),
]

_ACCOUNT_TYPES = {"account_id": "string", "account_name": "string", "industry": "string", "employee_bucket": "string", "region": "string",
                  "current_mrr": "decimal(10,2)", "subscription_plan": "string"}


def _profile() -> str:
    parts = [f"""SELECT 'accounts_stg' AS "table", '{c}' AS "column", '{t}' AS type, {str(c == 'account_id').lower()} AS is_key, count(*) AS rows,
        count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, count(DISTINCT {c}) AS distinct_values, '{t}' AS declared_type,
        {str(c == 'account_id').lower()} AS declared_key FROM account""" for c, t in _ACCOUNT_TYPES.items()]
    return sql("account", " UNION ALL ".join(parts))


def _all(cte: str, columns: str = "*") -> str:
    return sql(cte, f"SELECT {columns} FROM {cte}")


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["touches"] = _all("touch")
    o["touches_normalized"] = _all("touch", """* REPLACE (lower(trim(touch_type)) AS touch_type, lower(trim(utm_source)) AS utm_source,
        lower(trim(utm_medium)) AS utm_medium, lower(trim(utm_campaign)) AS utm_campaign)""")
    o["won_sales"] = _all("won", "* EXCLUDE (opportunity_id)")
    o["buyers"] = _all("won", "DISTINCT *")
    o["first_lead_date"] = _all("lead", "contact_id, min(created_at) AS first_lead_at") + " GROUP BY contact_id"
    o["order_touches"] = sql("path", """SELECT order_id, head.sale_amount AS sale_amount, head.booked_at AS booked_at, head.contact_id AS contact_id,
        n AS touches_per_order, head.touch_ts AS first_touch_ts, head.touch_type AS first_touch_type, tail.touch_ts AS last_touch_ts,
        tail.touch_type AS last_touch_type FROM path""")
    o["first_touch"] = sql("path", _detail("head"))
    o["last_touch"] = sql("path", _detail("tail"))
    o["linear_touch"] = sql("path", _LINEAR)
    o["first_touch_by_channel"] = _single_by_channel("head")
    o["last_touch_by_channel"] = _single_by_channel("tail")
    o["linear_by_channel"] = sql("path", f"""SELECT {_named('touch_type')} AS channel, count(DISTINCT order_id) AS sales_touched,
        CAST(round(sum(attributed_revenue), 2) AS DECIMAL(18,2)) AS total_revenue_credit FROM ({_LINEAR}) GROUP BY channel""")
    o["linear_credit_by_channel"] = o["linear_by_channel"]
    o["first_touch_by_month"] = sql("path", _by_month("head"))
    o["last_touch_by_month"] = sql("path", _by_month("tail"))
    o["linear_by_month"] = sql("path", f"""SELECT {_month('booked_at')} AS month_start, {_named('touch_type')} AS channel,
        count(DISTINCT order_id) AS customers_touched, sum(attributed_revenue) AS total_revenue_credit FROM ({_LINEAR}) GROUP BY ALL""")
    o["attribution_by_utm_medium"] = _by_utm("utm_medium")
    o["attribution_by_utm_campaign"] = _by_utm("utm_campaign")
    o["qa_reconcile"] = sql("won", f"""SELECT {_money("(SELECT sum(booked_amount * wins) FROM sale JOIN (SELECT opportunity_id, count(*) AS wins FROM opp WHERE win_flag = 1 GROUP BY ALL) USING (opportunity_id))")} AS total_won_revenue,
        (SELECT count(DISTINCT order_id) FROM won) AS total_won_orders, {_money("(SELECT sum(sale_amount) FROM won)")} AS revenue_in_attribution""")
    o["qa_untouched"] = sql("won path", f"""SELECT count(DISTINCT order_id) AS orders_with_no_touches, {_money('sum(sale_amount)')} AS revenue_with_no_touches
        FROM won WHERE order_id NOT IN (SELECT order_id FROM path)""")

    # influence
    opp_rows = _influence("deal", "opportunity_id", "opp_created_at", ", amount, stage, opp_created_at")
    o["opportunity_touches"] = sql("deal channel", f"SELECT opportunity_id, amount, stage, opp_created_at, channel AS touched_channel FROM ({opp_rows})")
    o["opp_influence"] = sql("deal channel", f"""SELECT channel, count(*) AS ops_influenced,
        {_ratio('count(*)', '(SELECT count(DISTINCT opportunity_id) FROM opp)', 2)} AS influence_opps_pct
        FROM ({_influence('deal', 'opportunity_id', 'opp_created_at')}) GROUP BY channel""")
    o["pipeline_influence"] = sql("deal channel", f"""SELECT channel, {_money('sum(amount)')} AS pipeline_influenced,
        {_ratio('sum(amount)', '(SELECT sum(amount) FROM opp)', 2, num_scale=2, den_scale=2)} AS influence_pipeline_pct FROM ({opp_rows}) GROUP BY channel""")
    o["customer_influence"] = sql("won channel", f"""SELECT channel, count(*) AS buyers_influenced,
        {_ratio('count(*)', '(SELECT count(DISTINCT order_id) FROM won)', 4)} AS influence_customers_pct
        FROM ({_influence('won', 'order_id', 'booked_at')}) GROUP BY channel""")

    # funnel
    o["lead_funnel"] = _funnel("source", "lead_source")
    o["funnel_by_month"] = _funnel(_month("created_at"), "month_start")
    o["overview_by_month"] = _overview()

    # LTV / CAC
    o["overall_cac"] = sql("cost sale", f"""SELECT {_ratio('(SELECT sum(spend) FROM cost)', '(SELECT count(order_id) FROM sale)', 6, num_scale=2, out='DECIMAL(38,6)')} AS CAC""")
    o["account_ltv"] = _all("lifetime")
    o["ltv_segments"] = _all("segment")
    o["ltv_by_abm"] = _all("segment", f"abm_status, {_LTV}") + " GROUP BY abm_status"
    o["ltv_by_industry"] = _all("segment", f"industry, {_LTV}") + " GROUP BY industry"
    o["ltv_by_segment"] = sql("segment", f"""SELECT segment, segment_value, count(*) AS accounts, {_LTV}
        FROM (SELECT unnest(['region', 'employee_bucket', 'subscription_plan', 'abm_tier']) AS segment,
                     unnest([region, employee_bucket, subscription_plan, abm_tier]) AS segment_value, total_ltv, lifetime_months, final_status
              FROM segment) GROUP BY segment, segment_value""")
    o["overall_ltv"] = _all("lifetime", _LTV)
    o["spend_vs_attribution"] = sql("path cost", f"""SELECT month_start, channel, paid AS spend, coalesce(customers_acquired, 0) AS customers_acquired,
        coalesce(total_revenue, 0::DECIMAL(38,2)) AS total_revenue, {_ratio('paid', 'customers_acquired', 2, num_scale=2)} AS cac,
        {_ratio('total_revenue', 'paid', 4, num_scale=2, den_scale=2)} AS roas
        FROM (SELECT month_start, channel, {_money('sum(spend)')} AS paid FROM cost GROUP BY ALL) LEFT JOIN ({_by_month('head')}) USING (month_start, channel)""")

    # staging
    o["stage_accounts"], o["stage_abm_accounts"], o["stage_leads"] = _all("account"), _all("abm"), _all("lead")
    o["stage_contacts"] = sql("contact", "SELECT DISTINCT ON (contact_id) * FROM contact ORDER BY contact_id, created_at DESC NULLS LAST, rid DESC")
    o["stage_opportunities"], o["stage_sales"], o["stage_spend"] = _all("opp"), _all("sale"), _all("cost")
    o["stage_sales_activities"], o["stage_email_engagement"], o["stage_web_sessions"] = _all("activity"), _all("mail"), _all("session")
    o["stage_content_engagement"] = """SELECT 'CNT' || event_id AS content_id, 'CON' || user_id AS contact_id,
        CASE WHEN event_id % 61 <> 0 THEN CAST(ts AS DATE) END AS engaged_at FROM events"""
    o["stage_seo"] = """SELECT 'PAGE' || p_partkey AS page_key, CASE WHEN p_partkey % 43 <> 0 THEN CAST(p_retailprice / 7 AS DECIMAL(10,2)) END AS avg_position FROM part"""
    o["stage_passthrough"], o["stage_assets"], o["stage_web_pageviews"] = "FROM supplier", "FROM part", "FROM pages"

    # data quality
    o["dup_keys"] = sql("raw_lead", f"SELECT {_RAW_LEAD} FROM raw_lead QUALIFY count(*) OVER (PARTITION BY lead_id) > 1")
    o["dup_key_checks"] = sql(" ".join(t for t, _ in _RAW_KEYS.values()), " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", count(*) AS repeated_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows
        FROM (SELECT count({k}) AS n FROM {t} GROUP BY {k}) WHERE n > 1""" for name, (t, k) in _RAW_KEYS.items()))
    o["dedup_preview"] = sql("raw_lead", f"""SELECT {_RAW_LEAD} FROM raw_lead EXCEPT ALL
        (SELECT DISTINCT ON (lead_id) {_RAW_LEAD} FROM raw_lead ORDER BY lead_id, first_response_at NULLS FIRST)""")
    for key in ("dup_keys", "dup_key_checks", "dedup_preview"):
        o[f"{key}_filtered"] = o[key]
    o["dedup_latest"] = sql("lead", "SELECT DISTINCT ON (contact_id) * FROM lead ORDER BY contact_id, created_at DESC NULLS LAST, lead_id DESC")
    o["dedup_earliest"] = sql("opp", """SELECT DISTINCT ON (lead_id) * FROM opp
        ORDER BY lead_id, created_at NULLS FIRST, opportunity_id, stage, amount, close_date NULLS FIRST, win_flag""")
    o["invalid_emails"] = sql("contact", "SELECT * FROM contact WHERE coalesce(NOT regexp_full_match(email, '(?s).*@.*\\.com'), true)")
    domains = {"abm_accounts_stg.target_reason": "abm", "accounts_stg.industry": "account", "accounts_stg.employee_bucket": "account", "email_engagement_stg.utm_campaign": "mail"}
    o["domain_values"] = sql("abm account mail", " UNION ALL ".join(
        f"""SELECT '{n.split('.')[0]}' AS "table", '{n.split('.')[1]}' AS "column", {n.split('.')[1]} AS value, count(*) AS rows FROM {t} GROUP BY ALL""" for n, t in domains.items()))
    o["distinct_account_names"] = _all("account", "count(DISTINCT account_name) AS distinct_account_name_count")
    o["lookup_key"] = _all("lead") + " WHERE contact_id = 'CON42'"
    o["date_rejects"] = f"""SELECT 'created_at' AS "column", count(*) AS rejected {_REJECTS[0][2]}"""
    o["convert_rejects"] = sql("twice", " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS rejected {rows}""" for t, c, rows in _REJECTS))
    o["profile_table"] = _profile()
    o["staged_rejects"], o["stored_leads"] = o["convert_rejects"], o["stage_leads"]
    o["stored_won_sales"], o["stored_lead_funnel"] = o["won_sales"], o["lead_funnel"]
    o["lead_funnel_bitmaps"], o["funnel_by_month_bitmaps"] = o["lead_funnel"], o["funnel_by_month"]
    o["dedup_latest_in_batches"], o["first_touch_by_month_refreshed"] = o["dedup_latest"], o["first_touch_by_month"]
    o["touch_index"] = sql("touch", """SELECT contact_id, row_number() OVER (PARTITION BY contact_id ORDER BY ts, touch_type NULLS FIRST, touch_id) AS touch_no,
        CAST(ts AS TIMESTAMP) AS ts, touch_type, touch_id FROM touch WHERE contact_id IS NOT NULL AND ts IS NOT NULL""")
    ends = ", ".join(f"arg_{f}(t, place).{c} AS {n}_touch_{a}" for n, f in (("first", "min"), ("last", "max")) for a, c in (("id", "touch_id"), ("ts", "ts"), ("type", "touch_type")))
    o["order_path_ends"] = sql("won touch", f"""SELECT any_value(order_id) AS order_id, any_value(sale_amount) AS sale_amount, any_value(booked_at) AS booked_at,
        any_value(contact_id) AS contact_id, count(*) AS touches, {ends}
        FROM (SELECT w.*, t, concat_ws(chr(1), strftime(t.ts, '%Y%m%d%H%M%S%f'), coalesce('~' || t.touch_type, ''), t.touch_id) AS place
              FROM (SELECT row_number() OVER () AS r, * FROM won) AS w JOIN touch AS t ON t.contact_id = w.contact_id AND t.ts <= w.booked_at) GROUP BY r""")
    o["touches_by_medium_collated"] = sql("touch", """SELECT min(ltrim(utm_medium)) AS utm_medium, count(*) AS rows, count(DISTINCT ltrim(utm_medium)) AS spellings
        FROM touch GROUP BY lower(trim(utm_medium))""")
    o["export_mart"] = o["first_touch_by_month"]
    return o
