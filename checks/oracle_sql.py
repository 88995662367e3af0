"""DuckDB SQL twins of the registered queries.

Each twin starts from the driver's tables: the common table expressions below map
them to the seven tables and build the shared stages, and a twin names the stages
it needs.
"""

AS_OF = "TIMESTAMP '2024-02-10 00:00:00'"
ACTIONS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def rnd(x: str, digits: int) -> str:
    """Half-even rounding of a double."""
    scale = f"{10 ** digits}::DOUBLE"
    return f"(round_even(({x})::DOUBLE * {scale}, 0) / {scale} + 0::DOUBLE)"


def days(start: str, end: str = AS_OF) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start}))::DOUBLE / 86400000000::DOUBLE) AS INTEGER)"


def pct(x: str) -> str:
    return f"CAST(CAST(round_even(({x}) * 100::DOUBLE, 0) AS BIGINT) AS VARCHAR) || '%'"


def whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {rnd(x, digits)})"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def cid(x: str) -> str:
    return f"'C' || lpad(CAST({x} AS VARCHAR), 7, '0')"


def pick(values, index: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[CAST({index} AS INTEGER) + 1]"


def num(column: str) -> str:
    return f"CAST(regexp_extract({column}, '(\\d+)', 1) AS BIGINT)"


PLAN = (
    "CASE WHEN c_custkey % 20 < 6 THEN 'Free' WHEN c_custkey % 20 < 13 THEN 'Starter'"
    " WHEN c_custkey % 20 < 18 THEN 'Pro' ELSE 'Enterprise' END"
)
MRR = (
    "(CASE WHEN c_custkey % 20 < 6 THEN 0::DOUBLE WHEN c_custkey % 20 < 13 THEN 49::DOUBLE"
    " WHEN c_custkey % 20 < 18 THEN 199::DOUBLE ELSE 999::DOUBLE END)"
    " * (0.9::DOUBLE + (c_custkey % 51)::DOUBLE / 100::DOUBLE)"
)


def score(factor: int) -> str:
    return rnd(f"((c_custkey * {factor}) % 10007)::DOUBLE / 10007::DOUBLE", 4)


EVENT_CUSTOMER = cid(
    "(user_id * 10 + 2 * (user_id % 5) + CASE WHEN day(ts) <= 10 AND event_id % 2 = 0 THEN 1 ELSE 0 END)"
)
LINE_ID = "CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INTEGER"
TICKET_STATUS = (
    "CASE WHEN l_suppkey % 20 < 3 THEN 'open' WHEN l_suppkey % 20 < 5 THEN 'in_progress'"
    " WHEN l_suppkey % 20 < 18 THEN 'resolved' ELSE 'escalated' END"
)
SHIPPED = "(l_shipdate + INTERVAL 8200 DAY)"

ACTIONABLE = (
    "escalate_to_csm", "send_retention_email", "send_reengagement_email", "send_upgrade_offer",
    "enroll_nurture_sequence", "proactive_support_call", "send_loyalty_reward", "send_health_checkin",
)
DELTAS = {
    "opened_clicked": 3.0, "discount_redeemed": 5.0, "logged_in": 4.0, "upgraded": 10.0, "reward_claimed": 4.0,
    "replied_positive": 5.0, "call_completed_retained": 8.0, "issue_resolved": 6.0, "enrolled_active": 3.0,
    "scheduled_followup": 1.0, "callback_scheduled": 1.0, "opened_only": 1.0, "clicked_not_converted": 0.5,
    "enrolled_passive": 0.5, "no_response": -1.0, "no_answer": -0.5, "bounced": -0.5, "unsubscribed": -5.0,
    "call_completed_churned": -10.0, "replied_negative": -3.0, "already_enrolled": 0.0, "escalated_csm": -1.0,
}
COOLDOWN = {
    "escalate_to_csm": 3, "send_retention_email": 7, "send_reengagement_email": 14, "send_upgrade_offer": 10,
    "enroll_nurture_sequence": 30, "proactive_support_call": 5, "send_loyalty_reward": 90, "send_health_checkin": 14,
    "no_action": 0,
}
DELTA = (
    "coalesce(CASE outcome " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in DELTAS.items()) + " END, 0::DOUBLE)"
)
COOLDOWN_CASE = (
    "CASE action_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COOLDOWN.items()) + " ELSE 7 END"
)
SUCCESS = (
    "('opened_clicked','discount_redeemed','logged_in','upgraded','reward_claimed','replied_positive',"
    "'call_completed_retained','issue_resolved','enrolled_active','enrolled_passive','replied_negative')"
)
FAILURE = "('unsubscribed','bounced','call_completed_churned','no_response','no_answer','already_enrolled')"
CLASS = f"CASE WHEN outcome IN {SUCCESS} THEN 'success' WHEN outcome IN {FAILURE} THEN 'failure' ELSE 'neutral' END"
OPENED = "CASE WHEN outcome IN ('no_response','bounced','unsubscribed') THEN 0 ELSE 1 END"
CLICKED = (
    "CASE WHEN outcome IN ('opened_clicked','upgraded','discount_redeemed','reward_claimed','logged_in') THEN 1 ELSE 0 END"
)

_VALID = (
    '{"action_type": " send_health_checkin ", "reason": "Quiet account, ask first", '
    '"priority": "3", "confidence": 0.85, "notes": "soft tone"}'
)
_KINDS = (
    f"'{_VALID}'",
    f"'```json' || chr(10) || '{_VALID}' || chr(10) || '```'",
    """'{"action_type": "send_flowers", "priority": 2}'""",
    """'{"action_type": "no_action"}'""",
    """'{"action_type": "escalate_to_csm", "reason": "Large account", "priority": 99, "confidence": 5}'""",
    """'{"action_type": "proactive_support_call", "reason": "  ", "priority": 2, "confidence": "abc"}'""",
    "'sorry, I cannot help'",
)

# Model features by group, in vector order.
FEATURES = {
    "customer": "tenure_days plan_rank mrr nps_score health_score employee_count".split(),
    "transaction": "txn_count total_spend avg_order_value refund_rate last_txn_days_ago".split(),
    "engagement": (
        "event_count_total event_count_30d avg_session_sec unique_channels unique_event_types"
        " days_since_last_event recency_score engagement_index"
    ).split(),
    "support": "ticket_count open_tickets critical_tickets avg_sentiment cancellation_risk unresolved_rate".split(),
    "email": ["open_rate", "click_rate"],
    "derived": ["risk_index"],
}
FEATURE_NAMES = [name for names in FEATURES.values() for name in names]

STAGES: dict[str, tuple[tuple[str, ...], str]] = {}


def stage(name: str, needs: str, sql: str) -> None:
    STAGES[name] = (tuple(needs.split()), sql)


stage("customers", "", f"""
SELECT {cid('c_custkey')} AS customer_id, c_name AS name, 'customer' || c_custkey || '@example.com' AS email,
  'Company ' || c_custkey AS company, c_mktsegment AS industry, {PLAN} AS plan, {MRR} AS mrr,
  {AS_OF} - to_days(CAST(30 + (c_custkey * 37) % 701 AS INTEGER)) AS signup_date, n_name AS country,
  CAST({pick((1, 5, 10, 25, 50, 100, 250, 500, 1000), 'c_custkey % 9')} AS INTEGER) AS employee_count,
  least(greatest((c_acctbal + 1000::DOUBLE) / 110::DOUBLE, 0::DOUBLE), 100::DOUBLE) AS health_score,
  CAST((c_custkey * 13) % 201 - 100 AS INTEGER) AS nps_score,
  CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS is_churned,
  CASE WHEN c_custkey % 5 = 0 THEN {AS_OF} - INTERVAL 10 DAY END AS churn_date, {AS_OF} AS created_at
FROM customer JOIN nation ON c_nationkey = n_nationkey""")

stage("transactions", "", """
SELECT 'T' || o_orderkey AS txn_id, 'C' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS customer_id,
  CASE WHEN o_orderkey % 20 < 19 THEN o_totalprice / 1000::DOUBLE ELSE -(o_totalprice / 1000::DOUBLE) END AS amount,
  'USD' AS currency,
  CASE WHEN o_orderkey % 20 < 8 THEN 'purchase' WHEN o_orderkey % 20 < 16 THEN 'renewal'
    WHEN o_orderkey % 20 < 19 THEN 'upgrade' ELSE 'refund' END AS txn_type,
  'P' || (o_orderkey % 30) AS product_id,
  CASE WHEN o_orderstatus <> 'P' THEN 'completed' WHEN o_orderpriority = '1-URGENT' THEN 'refunded' ELSE 'failed' END AS status,
  o_orderdate + INTERVAL 8200 DAY AS txn_date
FROM orders""")

stage("engagement_events", "", f"""
SELECT 'E' || event_id AS event_id, {EVENT_CUSTOMER} AS customer_id, event_type,
  {pick(('Email', 'SMS', 'Push', 'In-App', 'Sales Call'), "CAST(json_extract_string(props, '$.k') AS INTEGER) % 5")} AS channel,
  CAST(30 + floor(value * 10::DOUBLE) AS INTEGER) AS session_duration, ts AS event_date, props AS metadata
FROM events""")

stage("support_tickets", "", f"""
SELECT 'TK' || {LINE_ID} AS ticket_id, {cid('o_custkey')} AS customer_id,
  CASE WHEN l_partkey % 60 = 0 THEN 'cancellation'
    ELSE {pick(('billing', 'technical', 'onboarding', 'feature_request'), 'l_partkey % 4')} END AS topic,
  {TICKET_STATUS} AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
  1::DOUBLE - l_tax * 25::DOUBLE AS sentiment_score, {SHIPPED} AS opened_at,
  CASE WHEN {TICKET_STATUS} = 'resolved' THEN {SHIPPED} + INTERVAL 3 DAY END AS resolved_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag = 'R'""")

stage("email_log", "", f"""
SELECT 'EM' || {LINE_ID} AS email_id, {cid('o_custkey')} AS customer_id,
  {pick(('welcome', 'nurture', 're_engagement', 'upsell', 'retention'), 'l_partkey % 5')} AS email_type,
  {pick(('welcome', 'nurture', 're_engagement', 'upsell', 'retention'), 'l_partkey % 5')} AS subject,
  CASE WHEN l_quantity <= 17 THEN 1 ELSE 0 END AS opened,
  CASE WHEN l_quantity <= 17 AND l_linenumber = 1 THEN 1 ELSE 0 END AS clicked, {SHIPPED} AS sent_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_returnflag <> 'R'""")

stage("agent_actions", "", f"""
SELECT 'A' || event_id AS action_id, {EVENT_CUSTOMER} AS customer_id, {pick(ACTIONABLE, 'event_id % 8')} AS action_type,
  'fixture' AS reason, CAST(event_id % 5 + 1 AS INTEGER) AS priority,
  CASE WHEN event_id % 3 <> 0 THEN 'executed' ELSE 'pending' END AS status,
  CASE WHEN event_id % 3 <> 0 THEN {pick((*DELTAS, 'completed', None), '(event_id // 8) % 24')} END AS outcome,
  ts - INTERVAL 1 HOUR AS created_at,
  CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS executed_at,
  CASE WHEN event_id % 7 = 0 THEN '{{"context":{{"suggested_plan":"Pro"}}}}' WHEN event_id % 7 = 1 THEN '{{not json' END AS metadata,
  (event_id % 5 + 1)::DOUBLE * 3::DOUBLE + 1.05::DOUBLE + (event_id % 200)::DOUBLE / 100::DOUBLE AS urgency_score,
  CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN ts END AS feedback_applied_at
FROM events""")

stage("ml_predictions", "", f"""
SELECT 'PR' || c_custkey AS prediction_id, {cid('c_custkey')} AS customer_id, {score(7919)} AS churn_score,
  CASE WHEN c_custkey % 20 >= 18 THEN 1::DOUBLE ELSE {score(3571)} END AS conversion_score,
  {pick(('Champion', 'Loyal', 'At-Risk', 'Prospect', 'Lost'), 'c_custkey % 7 % 5')} AS segment,
  {rnd(f"({MRR}) * (1::DOUBLE - {score(7919)}) * 24::DOUBLE", 2)} AS ltv_estimate, {AS_OF} AS predicted_at
FROM customer""")

stage("responses", "", f"""
SELECT {cid('c_custkey')} AS customer_id, ([{', '.join(_KINDS)}])[CAST(c_custkey % 7 AS INTEGER) + 1] AS response
FROM customer WHERE c_custkey % 11 = 0""")

stage("base", "customers", f"""
SELECT *, {days('signup_date')} AS tenure_days,
  CASE plan WHEN 'Free' THEN 0 WHEN 'Starter' THEN 1 WHEN 'Pro' THEN 2 WHEN 'Enterprise' THEN 3 END AS plan_rank
FROM customers""")

stage("txn", "transactions", f"""
SELECT customer_id, count(txn_id) AS txn_count, {rnd('sum(amount)', 6)} AS total_spend,
  {rnd('sum(amount)', 6)} / count(amount)::DOUBLE AS avg_order_value,
  count(*) FILTER (WHERE status = 'refunded') AS refund_count, {days('max(txn_date)')} AS last_txn_days_ago,
  (count(*) FILTER (WHERE status = 'refunded'))::DOUBLE / greatest(count(txn_id), 1)::DOUBLE AS refund_rate
FROM transactions GROUP BY customer_id""")

stage("engagement", "engagement_events", f"""
SELECT customer_id, count(event_id) AS event_count_total,
  count(*) FILTER (WHERE event_date >= {AS_OF} - INTERVAL 30 DAY) AS event_count_30d,
  avg(session_duration) AS avg_session_sec, count(DISTINCT channel) AS unique_channels,
  count(DISTINCT event_type) AS unique_event_types, {days('max(event_date)')} AS days_since_last_event
FROM engagement_events GROUP BY customer_id""")

stage("tickets", "support_tickets", f"""
SELECT customer_id, count(ticket_id) AS ticket_count, count(*) FILTER (WHERE status = 'open') AS open_tickets,
  count(*) FILTER (WHERE priority = 'critical') AS critical_tickets,
  {rnd('sum(sentiment_score)', 6)} / count(sentiment_score)::DOUBLE AS avg_sentiment,
  count(*) FILTER (WHERE topic = 'cancellation') AS cancellation_risk,
  (count(*) FILTER (WHERE status = 'open'))::DOUBLE / greatest(count(ticket_id), 1)::DOUBLE AS unresolved_rate
FROM support_tickets GROUP BY customer_id""")

stage("mails", "email_log", """
SELECT customer_id, count(email_id) AS emails_sent, CAST(sum(opened) AS BIGINT) AS emails_opened,
  CAST(sum(clicked) AS BIGINT) AS emails_clicked, sum(opened)::DOUBLE / greatest(count(email_id), 1)::DOUBLE AS open_rate,
  sum(clicked)::DOUBLE / greatest(count(email_id), 1)::DOUBLE AS click_rate
FROM email_log GROUP BY customer_id""")

_INT = (
    "txn_count last_txn_days_ago event_count_total event_count_30d unique_channels unique_event_types"
    " days_since_last_event ticket_count open_tickets critical_tickets cancellation_risk"
).split()
_DBL = (
    "total_spend avg_order_value refund_rate avg_session_sec avg_sentiment unresolved_rate open_rate click_rate"
).split()

stage("filled", "base txn engagement tickets mails", f"""
SELECT customer_id, name, plan, tenure_days, coalesce(plan_rank, 0) AS plan_rank, mrr, nps_score, health_score,
  employee_count, is_churned, event_count_total IS NOT NULL AS has_events,
  {', '.join(f'coalesce({n}, 0) AS {n}' for n in _INT)},
  {', '.join(f'coalesce({n}, 0::DOUBLE) AS {n}' for n in _DBL)}
FROM base LEFT JOIN txn USING (customer_id) LEFT JOIN engagement USING (customer_id)
  LEFT JOIN tickets USING (customer_id) LEFT JOIN mails USING (customer_id)""")

_ENGAGEMENT_INDEX = (
    "event_count_30d::DOUBLE * 2::DOUBLE + avg_session_sec / 60::DOUBLE + open_rate * 10::DOUBLE + click_rate * 20::DOUBLE"
)
_RISK_INDEX = (
    "(cancellation_risk * 20 + critical_tickets * 10)::DOUBLE + unresolved_rate * 15::DOUBLE + refund_rate * 10::DOUBLE"
)
stage("features", "filled", f"""
SELECT *, 100::DOUBLE - least(greatest(days_since_last_event * 1.5::DOUBLE, 0::DOUBLE), 100::DOUBLE) AS recency_score,
  {rnd(_ENGAGEMENT_INDEX, 2)} AS engagement_index, {rnd(_RISK_INDEX, 2)} AS risk_index
FROM filled""")

stage("rfm", "features", """
SELECT customer_id, (100 - least(days_since_last_event, 100))::DOUBLE AS recency,
  (event_count_total + txn_count)::DOUBLE AS frequency, mrr + greatest(total_spend, 0::DOUBLE) AS monetary,
  engagement_index AS engagement, health_score AS health, tenure_days::DOUBLE AS tenure
FROM features""")

stage("enriched", "features ml_predictions", """
SELECT f.*, coalesce(p.churn_score, 0::DOUBLE) AS churn_score, coalesce(p.conversion_score, 0::DOUBLE) AS conversion_score,
  coalesce(p.segment, 'Unknown') AS segment, coalesce(p.ltv_estimate, 0::DOUBLE) AS ltv_estimate
FROM features f LEFT JOIN ml_predictions p USING (customer_id)""")

# id, priority, action, condition, reason, suggested plan, evidence columns
_RULES = (
    ("CHN-001", 5, "escalate_to_csm", "churn_score >= 0.8::DOUBLE AND mrr >= 100",
     f"'Churn probability ' || {pct('churn_score')} || ' while paying $' || {whole('mrr')} || ' a month: success manager to step in now'",
     "NULL", "churn segment"),
    ("CHN-002", 4, "send_retention_email", "churn_score >= 0.55::DOUBLE AND churn_score < 0.8::DOUBLE",
     f"'Churn probability ' || {pct('churn_score')} || ' in segment ' || segment || ': offer a reason to stay'",
     "NULL", "churn segment"),
    ("CHN-003", 3, "send_reengagement_email", "days_since_last_event >= 30 AND churn_score >= 0.35::DOUBLE",
     f"'Silent for ' || days_since_last_event || ' days with churn probability ' || {pct('churn_score')} || ': invite back'",
     "NULL", "churn"),
    ("CHN-004", 4, "proactive_support_call",
     "cancellation_risk >= 1 OR (avg_sentiment < (-0.4)::DOUBLE AND ticket_count >= 2)",
     f"cancellation_risk || ' cancellation tickets, mean sentiment ' || {fixed('avg_sentiment', 2)} || ': call before they do'",
     "NULL", ""),
    ("CNV-001", 4, "send_upgrade_offer", "conversion_score >= 0.7::DOUBLE AND plan_rank <= 1",
     f"'Upgrade probability ' || {pct('conversion_score')} || ' on plan ' || plan || ': make an offer'",
     "CASE WHEN plan_rank = 1 THEN 'Pro' ELSE 'Starter' END", "conversion"),
    ("CNV-002", 2, "enroll_nurture_sequence",
     "conversion_score >= 0.4::DOUBLE AND conversion_score < 0.7::DOUBLE AND plan_rank = 0",
     f"'Free user with upgrade probability ' || {pct('conversion_score')} || ': show the value step by step'",
     "NULL", "conversion tenure"),
    ("CNV-003", 3, "send_upgrade_offer",
     "plan_rank = 1 AND event_count_30d >= 20 AND conversion_score >= 0.5::DOUBLE",
     "'Starter customer with ' || event_count_30d || ' events in 30 days: outgrowing the plan'",
     "'Pro'", "conversion"),
    ("LYL-001", 2, "send_loyalty_reward", "segment = 'Champion' AND tenure_days >= 180",
     "'Champion for ' || tenure_days || ' days: say thank you'", "NULL", "segment tenure"),
    ("LYL-002", 1, "send_health_checkin", "health_score < 35 AND churn_score < 0.45::DOUBLE",
     f"'Health down to ' || {whole('health_score')} || ' of 100, churn still unlikely: ask how it goes'",
     "NULL", "churn"),
)


def _rule(order: int, rule) -> str:
    rule_id, priority, action, condition, reason, suggested, signals = rule
    churn = "churn_score" if "churn" in signals else "NULL::DOUBLE"
    conversion = "conversion_score" if "conversion" in signals else "NULL::DOUBLE"
    segment = "segment" if "segment" in signals else "NULL::VARCHAR"
    tenure = "tenure_days::BIGINT" if "tenure" in signals else "NULL::BIGINT"
    return (
        f"SELECT customer_id, '{action}' AS action_type, {reason} AS reason, {priority} AS priority,"
        f" '{rule_id}' AS rule_id, {order} AS rule_order, CAST({suggested} AS VARCHAR) AS suggested_plan,"
        f" {churn} AS churn_signal, {conversion} AS conversion_signal, {segment} AS segment_signal,"
        f" {tenure} AS tenure_signal FROM enriched WHERE {condition}"
    )


stage("candidates", "enriched", " UNION ALL ".join(_rule(i, r) for i, r in enumerate(_RULES)))

stage("sets", "candidates enriched", """
SELECT b.*, g.n_candidates, g.conflict, e.churn_score, e.ltv_estimate
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY priority DESC, rule_order) AS rn FROM candidates) b
JOIN (SELECT customer_id, count(*) AS n_candidates, count(DISTINCT action_type) > 1 AS conflict
      FROM candidates GROUP BY customer_id) g USING (customer_id)
JOIN enriched e USING (customer_id) WHERE b.rn = 1""")

stage("reviewed", "sets", """
SELECT * FROM sets WHERE conflict OR ltv_estimate >= 500 OR churn_score >= 0.6::DOUBLE ORDER BY customer_id LIMIT 30""")

_BARE = "trim(regexp_replace(regexp_replace(trim(response, ' ' || chr(10)), '^(```json)?(```)?', ''), '```$', ''), ' ' || chr(10))"
stage("parsed", "responses", f"""
SELECT customer_id, CASE WHEN json_valid({_BARE}) AND json_type(CASE WHEN json_valid({_BARE}) THEN {_BARE} END) = 'OBJECT'
  THEN {_BARE} END AS j FROM responses""")

_KNOWN = "(" + ",".join(f"'{a}'" for a in COOLDOWN) + ")"
stage("validated", "parsed", f"""
SELECT customer_id, trim(json_extract_string(j, '$.action_type')) AS decided_action,
  CASE WHEN json_type(j, '$.reason') = 'VARCHAR' AND trim(json_extract_string(j, '$.reason')) <> ''
    THEN substring(json_extract_string(j, '$.reason'), 1, 400) END AS decided_reason,
  CASE WHEN TRY_CAST(json_extract_string(j, '$.priority') AS INTEGER) BETWEEN 1 AND 5
    THEN TRY_CAST(json_extract_string(j, '$.priority') AS INTEGER) END AS decided_priority,
  least(greatest(coalesce(TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.7::DOUBLE), 0::DOUBLE), 1::DOUBLE) AS decided_confidence,
  coalesce(CASE WHEN json_type(j, '$.notes') = 'VARCHAR' THEN substring(json_extract_string(j, '$.notes'), 1, 300) END, '') AS notes
FROM parsed WHERE trim(json_extract_string(j, '$.action_type')) IN {_KNOWN}""")

stage("passthrough", "sets", """
SELECT customer_id, action_type, reason, priority, rule_id, false AS llm_enhanced, 0.7::DOUBLE AS confidence,
  suggested_plan, churn_signal, NULL::VARCHAR AS notes, NULL::BIGINT AS candidates, ltv_estimate FROM sets""")

stage("resolved", "sets reviewed validated", """
SELECT s.customer_id, coalesce(v.decided_action, s.action_type) AS action_type,
  CASE WHEN v.decided_action IS NOT NULL THEN coalesce(v.decided_reason, substring(s.reason, 1, 400)) ELSE s.reason END AS reason,
  coalesce(v.decided_priority, s.priority) AS priority, s.rule_id, v.decided_action IS NOT NULL AS llm_enhanced,
  coalesce(v.decided_confidence, 0.7::DOUBLE) AS confidence, s.suggested_plan, s.churn_signal, v.notes AS notes,
  CASE WHEN v.decided_action IS NOT NULL THEN s.n_candidates END AS candidates, s.ltv_estimate
FROM sets s LEFT JOIN (SELECT * FROM validated WHERE customer_id IN (SELECT customer_id FROM reviewed)) v USING (customer_id)
WHERE coalesce(v.decided_action, '') <> 'no_action'""")

stage("cooling", "agent_actions", f"""
SELECT DISTINCT customer_id, action_type FROM agent_actions
WHERE status = 'executed' AND executed_at >= {ACTIONS_AS_OF} - INTERVAL 90 DAY
  AND {days('executed_at', ACTIONS_AS_OF)} < {COOLDOWN_CASE}""")

_URGENCY = (
    "priority::DOUBLE * 3::DOUBLE + confidence * 1.5::DOUBLE + least(coalesce(ltv_estimate, 0::DOUBLE) / 2000::DOUBLE, 1::DOUBLE) * 2::DOUBLE"
)
stage("queue", "resolved cooling", f"""
SELECT r.*, {_URGENCY} AS urgency_score FROM resolved r ANTI JOIN cooling USING (customer_id, action_type)""")

stage("given", "agent_actions", f"""
SELECT action_id, CASE WHEN {num('action_id')} % 5 <> 0
    THEN {pick(('opened_clicked', 'no_response', 'upgraded', 'issue_resolved', 'bounced', 'callback_scheduled'),
               num('action_id') + ' % 6')} END AS new_outcome
FROM agent_actions""")

stage("conversion", "customers ml_predictions", """
SELECT customer_id, conversion_score, CASE WHEN conversion_score > 0 AND conversion_score <= 0.35::DOUBLE THEN 'Cold'
    WHEN conversion_score > 0.35::DOUBLE AND conversion_score <= 0.65::DOUBLE THEN 'Warm'
    WHEN conversion_score > 0.65::DOUBLE AND conversion_score <= 1 THEN 'Hot' END AS conversion_tier, plan AS current_plan
FROM customers JOIN ml_predictions USING (customer_id) WHERE plan <> 'Enterprise'
UNION ALL SELECT customer_id, 1::DOUBLE, 'Hot', plan FROM customers WHERE plan = 'Enterprise'""")

_LAST = f"CAST((epoch_us({AS_OF}) - epoch_us(max(event_date))) // 86400000000 AS INTEGER)"
stage("context", "customers engagement_events support_tickets agent_actions", f"""
SELECT c.customer_id, coalesce(e.days_since_last_event, 0) AS days_since_last_event,
  coalesce(t.open_tickets, 0) AS open_tickets, coalesce(t.open_tickets, 0) * greatest(coalesce(e.n, 0), 1) AS open_tickets_fanout,
  coalesce(t.avg_sentiment, 0::DOUBLE) AS avg_sentiment, {days('c.signup_date')} AS tenure_days
FROM customers c
LEFT JOIN (SELECT customer_id, count(*) AS n, {_LAST} AS days_since_last_event FROM engagement_events GROUP BY customer_id) e USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS open_tickets, {rnd('sum(sentiment_score)', 6)} / count(*)::DOUBLE AS avg_sentiment
           FROM support_tickets WHERE status = 'open' GROUP BY customer_id) t USING (customer_id)
WHERE c.customer_id IN (SELECT customer_id FROM agent_actions)""")

stage("batch", "agent_actions", f"""
SELECT * FROM agent_actions WHERE status = 'executed' AND executed_at >= {ACTIONS_AS_OF} - INTERVAL 48 HOUR
  AND feedback_applied_at IS NULL""")

_NEXT = "CASE plan WHEN 'Free' THEN 'Starter' WHEN 'Starter' THEN 'Pro' WHEN 'Pro' THEN 'Enterprise' ELSE 'Pro' END"
_SUGGESTED = f"""CASE WHEN json_valid(metadata) AND json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END,
  '$.context.suggested_plan') <> '' THEN json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.context.suggested_plan')
  ELSE {_NEXT} END"""

stage("message_rows", "agent_actions customers ml_predictions context", f"""
SELECT a.action_id, a.customer_id, CASE WHEN {num('a.action_id')} % 10 = 9 THEN 'call_partner' ELSE a.action_type END AS action_type,
  a.action_type AS own_type, a.reason, c.name, c.plan, c.mrr, split_part(c.name, ' ', 1) AS first_name,
  p.churn_score, p.conversion_score, p.ltv_estimate,
  x.days_since_last_event, x.open_tickets, x.avg_sentiment, x.tenure_days, {_SUGGESTED.replace('plan WHEN', 'c.plan WHEN')} AS target,
  CASE WHEN c.mrr >= 200 THEN 20 ELSE 15 END AS stay, CASE WHEN p.conversion_score >= 0.8::DOUBLE THEN 25 ELSE 15 END AS grow,
  upper(right(a.customer_id, 4)) AS tail, c.name || ' (' || a.customer_id || '), plan ' || c.plan AS who
FROM agent_actions a JOIN customers c USING (customer_id) JOIN ml_predictions p USING (customer_id) JOIN context x USING (customer_id)""")

_TIP = pick(
    ("Press the question mark on any page to see its shortcuts.", "Invoices can go to a second address.",
     "What you delete stays in the bin for 30 days.", "Lists can be filtered by several people at once."),
    "CAST('0x' || substring(md5(customer_id), 1, 8) AS BIGINT) % 4",
)
_BENEFITS = (
    "CASE target WHEN 'Starter' THEN 'nightly backups and a calendar view'"
    " WHEN 'Pro' THEN 'a sandbox to try changes in and ten times the API calls'"
    " WHEN 'Enterprise' THEN 'data kept in your region and a record of every change'"
    " ELSE 'all that comes with it' END"
)
_YEARS = fixed("tenure_days::DOUBLE / 365::DOUBLE", 1)
_URGENT = "avg_sentiment < (-0.5)::DOUBLE"
# action: subject, body lines, channel, call to action, discount
_TEXTS = {
    "send_retention_email": (
        "first_name || ', ' || stay || '% off if you stay with us'",
        ["'Hello ' || first_name || ','", "'your ' || plan || ' plan can do more for you than it did lately.'",
         "'Take ' || stay || '% off the next three months with SAVE' || stay || '-' || tail || ' within 7 days.'",
         "'Tell us what we should do better: a person answers every reply.'"],
        "email", "'Take ' || stay || '% off'", "stay"),
    "send_reengagement_email": (
        "'Something new since you left, ' || first_name",
        ["'Hello ' || first_name || ','", "'your last visit was ' || days_since_last_event || ' days ago.'", _TIP,
         "'Your ' || plan || ' account is as you left it.'"],
        "email", "'Come back'", "0"),
    "send_upgrade_offer": (
        "'From ' || plan || ' to ' || target || ' with ' || grow || '% off'",
        ["'Hello ' || first_name || ','", f"'with ' || target || ' you get: ' || {_BENEFITS} || '.'",
         "'Save ' || grow || '% for half a year with SAVE' || grow || '-' || tail || '.'"],
        "email", "'Move to ' || target", "grow"),
    "send_loyalty_reward": (
        f"{_YEARS} || ' years together, ' || first_name || ': thank you'",
        ["'Hello ' || first_name || ','", f"'you have been with us for ' || {_YEARS} || ' years.'",
         "'Your renewal is 10% cheaper with SAVE10-' || tail || ', and support puts you first for 3 months.'"],
        "email", "'Use the reward'", "10"),
    "send_health_checkin": (
        "'Does ' || plan || ' work for you?'",
        ["'Hello ' || first_name || ','",
         "'what is slow, unclear or missing for your team? Answer this mail and we read it.'"],
        "email", "'Answer'", "0"),
    "escalate_to_csm": (
        f"'[URGENT] ' || customer_id || ' may leave: churn ' || {pct('churn_score')}",
        ["who", f"'Pays $' || {whole('mrr')} || ' a month, lifetime value $' || format('{{:,}}', CAST(round_even(ltv_estimate, 0) AS BIGINT))",
         "'Call within a day, go through the tickets, offer a review, and up to 30% off if nothing else helps; note the result within two days.'"],
        "slack_csm", "'Note the result'", "0"),
    "proactive_support_call": (
        f"'[' || CASE WHEN {_URGENT} THEN 'URGENT' ELSE 'SCHEDULED' END || '] Call ' || customer_id",
        ["who", "'Open tickets: ' || open_tickets",
         f"'Sentiment: ' || {fixed('avg_sentiment', 2)} || ' (' || CASE WHEN avg_sentiment < 0 THEN 'Negative' ELSE 'Neutral/Positive' END || ')'",
         f"'Due within ' || CASE WHEN {_URGENT} THEN '48' ELSE '72' END || ' hours'"],
        "internal_task", "'Plan the call'", "0"),
    "enroll_nurture_sequence": (
        "'Start the nurture sequence for ' || customer_id",
        ["who", f"'Conversion ' || {pct('conversion_score')}",
         "'Five mails: day 1 a start, day 3 use cases, day 7 a story, day 14 an offer of 15% off, day 21 a personal note'"],
        "internal_task", "'Start'", "0"),
}


def _by_action(part) -> str:
    return "CASE action_type " + " ".join(f"WHEN '{a}' THEN {part(t)}" for a, t in _TEXTS.items())


MESSAGE = f"""
{_by_action(lambda t: t[0])} ELSE 'To do for ' || customer_id || ': ' || action_type END AS subject,
{_by_action(lambda t: ' || chr(10) || '.join(f'({line})' for line in t[1]))} ELSE 'To review: ' || reason END AS body,
{_by_action(lambda t: f"'{t[2]}'")} ELSE 'internal_task' END AS channel,
{_by_action(lambda t: t[3])} ELSE 'Review' END AS cta,
CAST({_by_action(lambda t: t[4])} ELSE 0 END AS INTEGER) AS discount_pct"""

stage("messages", "message_rows", f"SELECT action_id, customer_id, action_type, {MESSAGE} FROM message_rows")
stage("own_messages", "message_rows", f"""
SELECT action_id, customer_id, action_type, {MESSAGE}
FROM (SELECT * EXCLUDE (action_type, own_type), own_type AS action_type FROM message_rows)""")

ORACLE_SQL: dict[str, str] = {}


def _ordered(names: tuple[str, ...], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _ordered(STAGES[name][0], done)
            done.append(name)
    return done


def twin(name: str, needs: str, sql: str) -> None:
    """Register the SQL of a query, preceded by the stages it needs."""
    stages = ", ".join(f"{n} AS ({STAGES[n][1]})" for n in _ordered(tuple(needs.split()), []))
    ORACLE_SQL[name] = (f"WITH {stages} " if stages else "") + sql


_TIMES = {
    "customers": ("signup_date", "churn_date", "created_at"), "transactions": ("txn_date",),
    "engagement_events": ("event_date",), "support_tickets": ("opened_at", "resolved_at"),
    "email_log": ("sent_at",), "agent_actions": ("created_at", "executed_at", "feedback_applied_at"),
    "ml_predictions": ("predicted_at",),
}
_KEYS = {
    "customers": "customer_id", "transactions": "txn_id", "engagement_events": "event_id", "support_tickets": "ticket_id",
    "email_log": "email_id", "agent_actions": "action_id", "ml_predictions": "prediction_id",
}


def _plain(table: str, source: str | None = None) -> str:
    """All columns of a table with its times as text."""
    texts = ", ".join(f"{stamp(t)} AS {t}" for t in _TIMES[table])
    return f"SELECT * REPLACE ({texts}) FROM {source or table}"


for _table in _TIMES:
    twin(f"table_{_table}", _table, _plain(_table))

twin("table_volumes", " ".join(_TIMES), " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, min({k}) AS first_key, max({k}) AS last_key FROM {t}"
    for t, k in _KEYS.items()))
twin("predictions_for_rules", "ml_predictions",
     "SELECT customer_id, churn_score, conversion_score, segment, ltv_estimate FROM ml_predictions")
twin("predictions_rewritten", "ml_predictions", _plain("ml_predictions", "(SELECT * REPLACE (1::DOUBLE - churn_score AS churn_score) FROM ml_predictions)"))

_PENDING = """SELECT action_id, customer_id, status, urgency_score FROM agent_actions WHERE status <> 'pending'
UNION ALL SELECT 'N' || action_id, customer_id, status, urgency_score FROM agent_actions WHERE status = 'pending'"""
twin("pending_replaced", "agent_actions", _PENDING)
twin("pending_rewritten", "agent_actions", _PENDING)

_APPLIED = f"""
SELECT a.action_id, a.customer_id, CASE WHEN hit THEN 'executed' ELSE status END AS status,
  CASE WHEN hit THEN new_outcome ELSE outcome END AS outcome,
  {stamp(f"CASE WHEN hit THEN {AS_OF} ELSE executed_at END")} AS executed_at
FROM (SELECT a.*, g.new_outcome, g.action_id IS NOT NULL AND status = 'pending' AS hit
      FROM agent_actions a LEFT JOIN given g USING (action_id)) a"""
twin("outcomes_applied", "agent_actions given", _APPLIED)
twin("outcomes_committed", "agent_actions given", _APPLIED)

_MAIL = f"""SELECT 'ACT-' || action_id AS email_id, customer_id, action_type AS email_type, 'About ' || action_type AS subject,
  {OPENED} AS opened, {CLICKED} AS clicked, {stamp('executed_at')} AS sent_at
FROM agent_actions WHERE status = 'executed' AND action_type LIKE 'send_%'"""
twin("mail_log_rows", "agent_actions", _MAIL)
twin("mail_log_appended", "agent_actions email_log", f"{_plain('email_log')} UNION ALL {_MAIL}")
twin("customers_upserted", "customers", """
SELECT customer_id, name, plan, mrr + 20::DOUBLE AS mrr FROM customers
UNION ALL SELECT 'N' || customer_id, name, plan, mrr FROM customers""")
twin("legacy_actions_conformed", "agent_actions", f"""
SELECT * REPLACE ({', '.join(f'{stamp(t)} AS {t}' for t in ('created_at', 'executed_at'))}, NULL::VARCHAR AS metadata,
  NULL::DOUBLE AS urgency_score, NULL::VARCHAR AS feedback_applied_at) FROM agent_actions""")


def _checks(tables: dict[str, str]) -> str:
    def repeated(table, column):
        return (f"SELECT '{table}.{column} unique' AS rule, CAST(count({column}) - count(DISTINCT {column}) AS BIGINT)"
                f" AS violations FROM {tables[table]}")

    parts = [repeated(t, k) for t, k in _KEYS.items()] + [repeated("customers", "email")]
    parts += [
        f"SELECT '{t}.customer_id exists', count(*) FROM {tables[t]} WHERE customer_id NOT IN (SELECT customer_id FROM {tables['customers']})"
        for t in _KEYS if t != "customers"
    ]
    return " UNION ALL ".join(parts)


twin("constraint_report", " ".join(_KEYS), _checks({t: t for t in _KEYS}))
stage("damaged_customers", "customers", f"""
SELECT * FROM customers WHERE {num('customer_id')} % 13 <> 0
UNION ALL SELECT * FROM customers WHERE {num('customer_id')} % 7 = 0""")
stage("damaged_events", "engagement_events", f"""
SELECT * FROM engagement_events UNION ALL SELECT * FROM engagement_events WHERE {num('event_id')} % 4 = 0""")
twin("constraint_violations", " ".join(_KEYS) + " damaged_customers damaged_events",
     _checks({**{t: t for t in _KEYS}, "customers": "damaged_customers", "engagement_events": "damaged_events"}))
twin("transactions_from_csv", "transactions",
     f"SELECT txn_id, customer_id, {rnd('amount', 5)} AS amount, status, {stamp('txn_date')} AS txn_date, NULL::VARCHAR AS txn_type FROM transactions")

twin("customer_base", "base", "SELECT customer_id, plan, plan_rank, tenure_days, mrr, health_score FROM base")
twin("transaction_features", "txn", "SELECT * FROM txn")
twin("engagement_features", "engagement", "SELECT * FROM engagement")
twin("ticket_features", "tickets", "SELECT * FROM tickets")
twin("email_features", "mails", "SELECT * FROM mails")
twin("customer_features", "features", f"SELECT customer_id, {', '.join(FEATURE_NAMES)}, is_churned, has_events FROM features")
twin("customer_features_daily", "features", f"SELECT customer_id, {', '.join(FEATURE_NAMES)}, is_churned, has_events FROM features")
twin("feature_profile", "features", " UNION ALL ".join(
    f"SELECT '{group}' AS feature_group, {FEATURE_NAMES.index(n)} AS place, '{n}' AS feature,"
    f" {rnd(f'avg({n}::DOUBLE)', 4)} AS mean, {rnd(f'max({n}::DOUBLE)', 4)} AS max FROM features"
    for group, names in FEATURES.items() for n in names))
twin("action_context", "context", "SELECT * FROM context")

twin("score_labels", "ml_predictions", """
SELECT customer_id, churn_score, conversion_score,
  CASE WHEN churn_score > 0 AND churn_score <= 0.3::DOUBLE THEN 'Low' WHEN churn_score > 0.3::DOUBLE AND churn_score <= 0.6::DOUBLE THEN 'Medium'
    WHEN churn_score > 0.6::DOUBLE AND churn_score <= 1 THEN 'High' END AS churn_risk,
  CASE WHEN conversion_score > 0 AND conversion_score <= 0.35::DOUBLE THEN 'Cold'
    WHEN conversion_score > 0.35::DOUBLE AND conversion_score <= 0.65::DOUBLE THEN 'Warm'
    WHEN conversion_score > 0.65::DOUBLE AND conversion_score <= 1 THEN 'Hot' END AS conversion_tier
FROM ml_predictions""")
twin("conversion_tiers", "conversion", "SELECT * FROM conversion")
twin("rfm_signals", "rfm", "SELECT * FROM rfm")
_SIGNALS = ("recency", "frequency", "monetary", "engagement", "health", "tenure")
_WEIGHTS = {"recency": 0.25, "monetary": 0.3, "frequency": 0.2, "engagement": 0.15, "health": 0.1}
twin("cluster_profiles", "rfm", f"""
SELECT cluster, customers, {', '.join(f'{rnd(s, 4)} AS {s}' for s in _SIGNALS)}, {rnd('score', 4)} AS score,
  CAST(rank AS INTEGER) AS rank, {pick(('Champion', 'Loyal', 'At-Risk', 'Prospect', 'Lost'), 'rank - 1')} AS segment
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cluster) AS rank
  FROM (SELECT *, {rnd(' + '.join(f'{s} * {w}::DOUBLE' for s, w in _WEIGHTS.items()), 6)} AS score
    FROM (SELECT CAST({num('customer_id')} % 5 AS INTEGER) AS cluster, count(*) AS customers,
      {', '.join(f'{rnd(f"avg({s})", 6)} AS {s}' for s in _SIGNALS)} FROM rfm GROUP BY 1)))""")
_RANGES = {"recency": 100, "frequency": 200, "monetary": 10000, "engagement": 500, "health": 100, "tenure": 1000}
_CENTRES = (
    (0.1, 0.2, 0.1, 0.1, 0.5, 0.5), (0.9, 0.5, 0.3, 0.4, 0.2, 0.8), (0.5, 0.9, 0.7, 0.6, 0.8, 0.2),
    (1.0, 0.1, 0.9, 0.0, 0.9, 0.9), (0.3, 0.3, 0.5, 0.9, 0.1, 0.1),
)
_DISTANCES = ", ".join(
    "sqrt(" + " + ".join(
        f"({s} / {r}::DOUBLE - {c}::DOUBLE) * ({s} / {r}::DOUBLE - {c}::DOUBLE)"
        for (s, r), c in zip(_RANGES.items(), centre)) + ")"
    for centre in _CENTRES)
twin("segment_confidence", "rfm", f"""
SELECT customer_id, {rnd(f'1::DOUBLE - least({_DISTANCES}) / (greatest({_DISTANCES}) + 1e-9::DOUBLE)', 3)} AS segment_confidence
FROM rfm""")
twin("lifetime_values", "customers ml_predictions", f"""
SELECT customer_id, mrr, churn_score, {rnd('mrr * (1::DOUBLE - churn_score) * 24::DOUBLE', 2)} AS ltv
FROM customers JOIN ml_predictions USING (customer_id)""")
twin("assembled_predictions", "customers ml_predictions conversion", f"""
SELECT p.customer_id, p.churn_score, CASE WHEN {num('p.customer_id')} % 4 = 0 THEN 0.5::DOUBLE ELSE v.conversion_score END AS conversion_score,
  CASE WHEN {num('p.customer_id')} % 9 = 0 THEN 'Unknown' ELSE p.segment END AS segment,
  {rnd('c.mrr * (1::DOUBLE - p.churn_score) * 24::DOUBLE', 2)} AS ltv_estimate, {stamp(AS_OF)} AS predicted_at
FROM ml_predictions p JOIN customers c USING (customer_id) JOIN conversion v USING (customer_id)""")
twin("inference_summary", "ml_predictions conversion", f"""
SELECT count(*) AS customers_scored, {rnd('avg(churn_score)', 3)} AS avg_churn_score,
  count(*) FILTER (WHERE churn_score > 0.6::DOUBLE) AS high_risk, {rnd('sum(ltv_estimate)', 2)} AS total_ltv,
  (SELECT count(*) FROM conversion WHERE conversion_tier = 'Hot') AS hot_conversions,
  count(*) FILTER (WHERE segment = 'Champion') AS in_champion, count(*) FILTER (WHERE segment = 'Loyal') AS in_loyal,
  count(*) FILTER (WHERE segment = 'At-Risk') AS in_at_risk, count(*) FILTER (WHERE segment = 'Prospect') AS in_prospect,
  count(*) FILTER (WHERE segment = 'Lost') AS in_lost, count(*) FILTER (WHERE segment = 'Unknown') AS in_unknown
FROM ml_predictions""")
stage("judged", "customers ml_predictions", """
SELECT is_churned AS label, CASE WHEN churn_score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS predicted
FROM customers JOIN ml_predictions USING (customer_id)""")
stage("class_report", "judged", f"""
SELECT class, {rnd('hit::DOUBLE / greatest(called, 1)::DOUBLE', 6)} AS precision, {rnd('hit::DOUBLE / greatest(support, 1)::DOUBLE', 6)} AS recall,
  {rnd('CASE WHEN hit > 0 THEN 2::DOUBLE * hit::DOUBLE / (called + support)::DOUBLE ELSE 0::DOUBLE END', 6)} AS f1, support
FROM (SELECT class, count(*) FILTER (WHERE label = class AND predicted = class) AS hit,
    count(*) FILTER (WHERE predicted = class) AS called, count(*) FILTER (WHERE label = class) AS support
  FROM judged CROSS JOIN (SELECT unnest([0, 1]) AS class) GROUP BY class)""")
twin("classification_report", "class_report", "SELECT * FROM class_report")
_AVERAGES = {
    "accuracy": ["sum(recall * support) / sum(support)"] * 3,
    "macro": [f"avg({m})" for m in ("precision", "recall", "f1")],
    "weighted": [f"sum({m} * support) / sum(support)" for m in ("precision", "recall", "f1")],
}
twin("classification_averages", "class_report", " UNION ALL ".join(
    f"SELECT '{kind}' AS average, " + ", ".join(f"{rnd(x, 6)} AS {m}" for m, x in zip(("precision", "recall", "f1"), of))
    + " FROM class_report" for kind, of in _AVERAGES.items()))
twin("confusion_matrix", "judged", "SELECT label, predicted, count(*) AS customers FROM judged GROUP BY label, predicted")

twin("enriched_customers", "features ml_predictions", f"""
SELECT f.customer_id, f.plan, coalesce(p.churn_score, 0::DOUBLE) AS churn_score, coalesce(p.conversion_score, 0::DOUBLE) AS conversion_score,
  coalesce(p.segment, 'Unknown') AS segment, coalesce(p.ltv_estimate, 0::DOUBLE) AS ltv_estimate, f.engagement_index
FROM features f LEFT JOIN (SELECT * FROM ml_predictions WHERE {num('customer_id')} % 4 <> 0) p USING (customer_id)""")
# Column, type and rules of the other evidence.
_SIGNALS = (
    ("mrr", "DOUBLE", "CHN-001"), ("health_score", "DOUBLE", "CHN-002 LYL-001 LYL-002"), ("days_since_last_event", "BIGINT", "CHN-003"),
    ("event_count_30d", "BIGINT", "CHN-003 CNV-003"), ("cancellation_risk", "BIGINT", "CHN-004"), ("avg_sentiment", "DOUBLE", "CHN-004"),
    ("open_tickets", "BIGINT", "CHN-004"), ("plan", "VARCHAR", "CNV-001 CNV-002 CNV-003"), ("engagement_index", "DOUBLE", "CNV-001"),
    ("nps_score", "BIGINT", "LYL-002"),
)
_EVIDENCE = ", ".join(
    f"CASE WHEN rule_id IN ({', '.join(repr(r) for r in rules.split())}) THEN e.{name}::{kind} END AS {name}_signal" for name, kind, rules in _SIGNALS
)
twin("rule_candidates", "candidates enriched", f"SELECT c.*, {_EVIDENCE} FROM candidates c JOIN enriched e USING (customer_id)")
twin("rule_summary", "candidates", """
SELECT 'action' AS kind, action_type AS value, count(*) AS candidates FROM candidates GROUP BY action_type
UNION ALL SELECT 'priority', 'P' || priority || ' ' || (['INFO','LOW','MEDIUM','HIGH','CRITICAL'])[priority], count(*) FROM candidates GROUP BY priority
UNION ALL SELECT 'rule', rule_id, count(*) FROM candidates GROUP BY rule_id""")
twin("priority_mismatches", "candidates", """
SELECT rule_id, CASE rule_id WHEN 'CHN-002' THEN 4 ELSE 1 END AS expected, CASE rule_id WHEN 'CHN-002' THEN 3 ELSE 2 END AS emitted,
  count(*) AS candidates FROM candidates WHERE rule_id IN ('CHN-002', 'LYL-002') GROUP BY rule_id""")
twin("python_rule_candidates", "customers", """
SELECT customer_id, CASE WHEN nps >= -90 THEN 'send_health_checkin' END AS action_type,
  CASE WHEN nps >= -90 THEN 'NPS ' || nps || ', shelf '
    || CAST(list_sum(list_transform(string_split(substring(customer_id, 2), ''), lambda x: x::INTEGER)) % 9 AS BIGINT) END AS reason,
  2 AS priority, 'PY-001' AS rule_id,
  CASE WHEN nps < -90 THEN 'ValueError: nps out of range' WHEN nps IS NULL THEN 'TypeError: priority is str' END AS error
FROM (SELECT *, CASE WHEN CAST(substring(customer_id, 2) AS BIGINT) % 50 <> 0 THEN nps_score END AS nps FROM customers)
WHERE plan = 'Pro' AND nps < -50 OR nps IS NULL""")

twin("batch_rule_candidates", "customers", """
SELECT customer_id, CASE WHEN NOT bad THEN 'send_loyalty_reward' END AS action_type, CASE WHEN NOT bad THEN 'NPS ' || nps_score END AS reason,
  2 AS priority, 'PB-001' AS rule_id, CASE WHEN bad THEN 'LookupError: no profile' END AS error
FROM (SELECT *, customer_id IN ('C0000011', 'C0000042', 'C0000097') AS bad FROM customers)
WHERE bad OR plan <> 'Free' AND nps_score > 60""")
twin("rule_candidates_apart", "candidates enriched", """
SELECT customer_id, action_type, reason, priority, rule_id, CAST(NULL AS VARCHAR) AS error FROM candidates
UNION ALL
SELECT customer_id, CASE WHEN days_since_last_event <> 0 THEN 'send_health_checkin' END, CASE WHEN days_since_last_event <> 0 THEN event_count_total || ' events' END,
  2, 'OWN-001', CASE WHEN days_since_last_event = 0 THEN 'the condition cannot be computed' END
FROM enriched WHERE days_since_last_event = 0 OR event_count_total::DOUBLE / nullif(days_since_last_event, 0)::DOUBLE > 0.5::DOUBLE""")

_SETS = "SELECT customer_id, rule_id, priority, n_candidates, conflict, churn_score, ltv_estimate FROM sets"
twin("fired_sets", "sets", _SETS)
twin("fired_sets_from_candidates", "sets", _SETS)
_PLANS = (
    "SELECT customer_id, action_type, reason, priority, rule_id, llm_enhanced, confidence, suggested_plan, churn_signal, notes, candidates"
)
twin("passthrough_plans", "passthrough", f"{_PLANS} FROM passthrough")
twin("review_candidates", "reviewed", "SELECT customer_id, n_candidates, conflict, churn_score, ltv_estimate FROM reviewed")
_LINES = "string_agg('* ' || rule_id || ' proposes ' || action_type || ' at priority ' || priority || ': ' || reason, chr(10) ORDER BY rule_order)"
_ASK = """Answer with one JSON object that has action_type, reason, priority (1 to 5), confidence (0 to 1) and notes.
action_type is one of
- escalate_to_csm: CHN-001 at priority 5
- send_retention_email: CHN-002 at priority 4
- send_reengagement_email: CHN-003 at priority 3
- send_upgrade_offer: CNV-001 at priority 4, CNV-003 at priority 3
- enroll_nurture_sequence: CNV-002 at priority 2
- proactive_support_call: CHN-004 at priority 4
- send_loyalty_reward: LYL-001 at priority 2
- send_health_checkin: LYL-002 at priority 1
- no_action: when no proposal fits
Keep the proposal of the highest priority unless the figures above speak against its reason."""
twin("decision_prompts", "reviewed candidates enriched", f"""
SELECT customer_id, 'Customer ' || customer_id || chr(10) || 'Plan ' || plan || ', $' || {fixed('mrr', 2)} || ' a month, ' || tenure_days || ' days with us'
  || chr(10) || 'Segment ' || segment || ', health ' || {whole('health_score')} || ' of 100, NPS ' || nps_score
  || chr(10) || 'Churn ' || {fixed('churn_score', 3)} || ', conversion ' || {fixed('conversion_score', 3)} || ', lifetime value $' || {whole('ltv_estimate')}
  || chr(10) || 'Events in 30 days ' || event_count_30d || ', open tickets ' || open_tickets || ', sentiment ' || {fixed('avg_sentiment', 2)}
  || ', last event ' || days_since_last_event || ' days ago' || chr(10) || 'Proposals:' || chr(10) || lines || chr(10)
  || '{_ASK}' AS prompt
FROM enriched JOIN (SELECT customer_id, {_LINES} AS lines FROM candidates GROUP BY customer_id) USING (customer_id)
WHERE customer_id IN (SELECT customer_id FROM reviewed)""")
twin("parsed_decisions", "parsed", """
SELECT customer_id, j IS NOT NULL AS is_object, json_extract_string(j, '$.action_type') AS action_type,
  json_extract_string(j, '$.priority') AS priority FROM parsed""")
twin("validated_decisions", "validated", "SELECT * FROM validated")
twin("resolved_plans", "resolved", f"{_PLANS} FROM resolved")
twin("plan_summary", "resolved", """
SELECT action_type, count(*) AS plans, count(*) FILTER (WHERE llm_enhanced) AS enhanced,
  count(*) FILTER (WHERE NOT llm_enhanced) AS passthrough FROM resolved GROUP BY action_type""")

twin("cooldown_pairs", "cooling", "SELECT * FROM cooling")
twin("plans_after_cooldown", "passthrough cooling",
     "SELECT customer_id, action_type, priority, rule_id FROM passthrough ANTI JOIN cooling USING (customer_id, action_type)")
twin("plan_urgency", "passthrough", f"SELECT customer_id, action_type, {rnd(_URGENCY, 6)} AS urgency_score FROM passthrough")
twin("queued_actions", "queue", f"""
SELECT customer_id, action_type, priority, 'pending' AS status, {stamp(ACTIONS_AS_OF)} AS created_at,
  {rnd('urgency_score', 6)} AS urgency_score, sha256(customer_id || '|' || action_type || '|' || {stamp(ACTIONS_AS_OF)}) AS action_id,
  reason, suggested_plan, churn_signal, notes, candidates FROM queue""")
twin("queue_priorities", "queue", "SELECT priority, count(*) AS queued FROM queue GROUP BY priority")
_URGENT_FIRST = "ORDER BY urgency_score DESC NULLS LAST, priority DESC NULLS LAST, created_at ASC NULLS FIRST, action_id"
twin("pending_queue", "agent_actions",
     _plain("agent_actions", f"(SELECT * FROM agent_actions WHERE status = 'pending' {_URGENT_FIRST} LIMIT 100)"))
twin("decision_cycle_summary", "customers candidates resolved queue", f"""
SELECT (SELECT count(*) FROM customers) AS customers, (SELECT count(*) FROM candidates) AS candidates,
  (SELECT count(*) FROM resolved) AS plans, (SELECT count(*) FROM resolved WHERE llm_enhanced) AS llm_enhanced,
  (SELECT count(*) FROM queue) AS queued_actions, (SELECT count(*) FROM queue WHERE priority = 5) AS critical,
  (SELECT count(*) FROM queue WHERE priority = 4) AS high,
  (SELECT count(*) FROM resolved) - (SELECT count(*) FROM queue) AS cooldown_skipped, {stamp(AS_OF)} AS cycle_at""")

twin("outcome_classes", "agent_actions", f"""
SELECT action_id, outcome, {CLASS} AS outcome_class, {OPENED} AS opened, {CLICKED} AS clicked, {DELTA} AS delta
FROM agent_actions WHERE status = 'executed'""")
twin("rendered_messages", "messages", "SELECT * FROM messages")
twin("discount_codes", "customers", """
SELECT customer_id, 'SAVE' || CASE WHEN mrr >= 200 THEN 20 ELSE 15 END || '-' || upper(right(customer_id, 4)) AS code FROM customers""")
twin("suggested_plans", "agent_actions customers",
     f"SELECT action_id, {_SUGGESTED} AS suggested_plan FROM agent_actions LEFT JOIN customers USING (customer_id)")
twin("execution_batch", "agent_actions own_messages given", f"""
SELECT action_id, customer_id, action_type, 'executed' AS status, outcome, {CLASS} AS outcome_class,
  {stamp(AS_OF)} AS executed_at, subject, channel, discount_pct
FROM (SELECT m.*, coalesce(g.new_outcome, 'completed') AS outcome
  FROM (SELECT action_id FROM agent_actions WHERE status = 'pending' {_URGENT_FIRST} LIMIT 50) b
  JOIN own_messages m USING (action_id) LEFT JOIN given g USING (action_id))""")


def _rates(action: str, tail: str) -> str:
    def of(name):
        return f"count(*) FILTER (WHERE class = '{name}')"

    rates = ", ".join(f"{rnd(f'({of(n)})::DOUBLE / count(*)::DOUBLE', 4)} AS {n}_rate" for n in ("success", "neutral", "failure"))
    return (f"SELECT {action} AS action_type, count(*) AS total, {of('success')} AS success, {of('neutral')} AS neutral,"
            f" {of('failure')} AS failure, {rates} FROM classed {tail}")


stage("classed", "agent_actions", f"SELECT action_type, {CLASS} AS class FROM agent_actions WHERE status = 'executed'")
twin("execution_report", "classed", _rates("action_type", "GROUP BY action_type") + " UNION ALL " + _rates("'ALL'", ""))
twin("pending_feedback", "batch", f"SELECT action_id, customer_id, outcome, {stamp('executed_at')} AS executed_at FROM batch")


def _folded(source: str, order: str) -> str:
    """Health after the ordered, clamped steps of each customer."""
    return f"""
SELECT c.customer_id, {rnd('''CASE WHEN l.steps IS NULL THEN c.health_score ELSE
    list_reduce(l.steps, lambda a, x: least(greatest(a + x, 0::DOUBLE), 100::DOUBLE), c.health_score) END''', 6)} AS health_score
FROM customers c LEFT JOIN (SELECT customer_id, list({DELTA} ORDER BY {order}) AS steps FROM {source}
  WHERE {DELTA} <> 0 GROUP BY customer_id) l USING (customer_id)"""


twin("updated_health", "customers agent_actions", _folded(
    f"(SELECT * FROM agent_actions WHERE status = 'executed' AND executed_at >= {ACTIONS_AS_OF} - INTERVAL 744 HOUR AND feedback_applied_at IS NULL)",
    "executed_at, action_id"))
twin("feedback_run_health", "customers batch", _folded("batch", "executed_at, action_id"))
stage("page", "agent_actions given", f"""
SELECT b.action_id, b.action_type, coalesce(g.new_outcome, 'completed') AS outcome
FROM (SELECT * FROM agent_actions WHERE status = 'pending' {_URGENT_FIRST} LIMIT 2000) b LEFT JOIN given g USING (action_id)""")
twin("execution_run", "agent_actions page", f"""
SELECT a.action_id, CASE WHEN p.action_id IS NULL THEN a.status ELSE 'executed' END AS status,
  CASE WHEN p.action_id IS NULL THEN a.outcome ELSE p.outcome END AS outcome,
  CASE WHEN p.action_type LIKE 'send_%' THEN {OPENED.replace('outcome', 'p.outcome')} END AS opened,
  CASE WHEN p.action_type LIKE 'send_%' THEN {CLICKED.replace('outcome', 'p.outcome')} END AS clicked
FROM agent_actions a LEFT JOIN page p USING (action_id)""")
twin("marked_actions", "agent_actions batch", f"""
SELECT action_id, status, {stamp(f"CASE WHEN action_id IN (SELECT action_id FROM batch) THEN {ACTIONS_AS_OF} ELSE feedback_applied_at END")}
  AS feedback_applied_at FROM agent_actions""")
twin("feedback_after_marking", "batch", f"""
SELECT outcome, count(*) AS left_over, min(action_id) AS first_left FROM batch WHERE {num('action_id')} % 2 <> 0 GROUP BY outcome""")
twin("feedback_logged", "batch", f"""
SELECT action_id, {stamp('executed_at')} AS executed_at, {stamp(ACTIONS_AS_OF)} AS feedback_applied_at FROM batch""")
twin("feedback_summary", "batch", f"""
SELECT count(*) AS executions_processed, count(*) FILTER (WHERE {DELTA} <> 0) AS health_updates,
  count(*) FILTER (WHERE {DELTA} > 0) AS positive_outcomes, count(*) FILTER (WHERE {DELTA} < 0) AS negative_outcomes,
  count(*) FILTER (WHERE outcome = 'call_completed_churned') AS churn_confirmed,
  count(*) FILTER (WHERE outcome = 'upgraded') AS upgrades_confirmed FROM batch HAVING count(*) > 0""")
twin("feedback_signals", "batch", """
SELECT customer_id, action_id, CASE outcome WHEN 'upgraded' THEN 'upgrade_confirmed' ELSE 'churn_confirmed' END AS signal
FROM batch WHERE outcome IN ('upgraded', 'call_completed_churned')""")

twin("kpi_summary", "customers ml_predictions agent_actions", f"""
SELECT c.*, p.*, a.* FROM
 (SELECT count(*) AS total_customers, count(*) FILTER (WHERE is_churned = 0) AS active_customers,
    coalesce({rnd('sum(mrr) FILTER (WHERE is_churned = 0)', 2)}, 0::DOUBLE) AS total_mrr,
    count(*) - count(*) FILTER (WHERE is_churned = 0) AS churned_customers,
    {rnd('(count(*) - count(*) FILTER (WHERE is_churned = 0))::DOUBLE / count(*)::DOUBLE * 100::DOUBLE', 2)} AS churn_rate FROM customers) c,
 (SELECT coalesce({rnd('sum(ltv_estimate)', 2)}, 0::DOUBLE) AS total_ltv, count(*) FILTER (WHERE churn_score >= 0.6::DOUBLE) AS high_risk_count,
    count(*) FILTER (WHERE conversion_score >= 0.7::DOUBLE) AS hot_conversions FROM ml_predictions) p,
 (SELECT count(*) FILTER (WHERE status = 'executed') AS actions_executed, count(*) FILTER (WHERE status = 'pending') AS actions_pending
  FROM agent_actions) a""")


def short_money(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e6 THEN '$' || {fixed(f'{x} / 1e6::DOUBLE', 2)} || 'M'"
            f" WHEN {x} >= 1e3 THEN '$' || {fixed(f'{x} / 1e3::DOUBLE', 1)} || 'K' ELSE '$' || {whole(x)} END")


twin("kpi_texts", "customers ml_predictions", f"""
SELECT (SELECT {short_money("mrr")} FROM (SELECT {rnd('sum(mrr)', 2)} AS mrr FROM customers WHERE is_churned = 0)) AS mrr,
  (SELECT {short_money("ltv")} FROM (SELECT {rnd('sum(ltv_estimate)', 2)} AS ltv FROM ml_predictions)) AS ltv""")
twin("segment_counts", "ml_predictions", f"""
SELECT segment, count(*) AS customers, {rnd('avg(churn_score)', 2)} AS avg_churn,
  {rnd('count(*)::DOUBLE * 100::DOUBLE / (SELECT count(*) FROM ml_predictions)::DOUBLE', 2)} AS share_pct
FROM ml_predictions GROUP BY segment""")
stage("scored", "customers ml_predictions", """
SELECT c.*, p.churn_score, p.conversion_score, p.segment, p.ltv_estimate, p.predicted_at
FROM customers c JOIN ml_predictions p USING (customer_id)""")
_LISTED = "customer_id, name, plan, mrr, health_score, churn_score, conversion_score, segment, ltv_estimate"
twin("customer_list", "scored", f"""
SELECT {_LISTED} FROM scored WHERE is_churned = 0 AND churn_score BETWEEN 0 AND 1 ORDER BY churn_score DESC, customer_id LIMIT 50""")
twin("customer_list_filtered", "scored", f"""
SELECT {_LISTED} FROM scored WHERE is_churned = 0 AND plan = 'Starter' AND segment = 'Loyal'
  AND churn_score >= 0.2::DOUBLE AND churn_score <= 0.9::DOUBLE ORDER BY churn_score DESC, customer_id LIMIT 20 OFFSET 5""")
_BANDS = f"""SELECT {_LISTED}, {stamp('predicted_at')} AS predicted_at,
  CASE WHEN churn_score >= 0.6::DOUBLE THEN 'High' WHEN churn_score >= 0.3::DOUBLE THEN 'Medium' ELSE 'Low' END AS churn_risk,
  CASE WHEN conversion_score >= 0.7::DOUBLE THEN 'Hot' WHEN conversion_score >= 0.4::DOUBLE THEN 'Warm' ELSE 'Cold' END AS conversion_tier
FROM scored"""
twin("risk_profiles", "scored", _BANDS)
twin("customer_risk", "scored", f"{_BANDS} WHERE customer_id = 'C0000007'")
twin("customer_actions", "agent_actions", _plain("agent_actions") + " WHERE customer_id = 'C0000010'")
twin("churn_ranking", "scored", """
SELECT customer_id, name, plan, mrr, churn_score, segment, ltv_estimate,
  CASE WHEN churn_score > 0.4::DOUBLE THEN 'escalate_to_csm' WHEN churn_score > 0.3::DOUBLE THEN 'send_retention_email'
    ELSE 'send_health_checkin' END AS suggested_action
FROM scored WHERE churn_score >= 0.1::DOUBLE AND is_churned = 0 ORDER BY churn_score DESC, customer_id LIMIT 50""")
twin("conversion_ranking", "scored", """
SELECT customer_id, name, plan, mrr, conversion_score, segment FROM scored
WHERE conversion_score >= 0.5::DOUBLE AND plan <> 'Enterprise' ORDER BY conversion_score DESC, customer_id LIMIT 50""")
twin("segment_metrics", "scored", f"""
SELECT segment, count(*) AS customer_count, {rnd('avg(churn_score)', 3)} AS avg_churn_score,
  {rnd('avg(conversion_score)', 3)} AS avg_conversion_score, {rnd('avg(mrr)', 2)} AS avg_mrr,
  {rnd('sum(ltv_estimate)', 2)} AS total_ltv FROM scored GROUP BY segment""")
twin("action_queue", "agent_actions", _plain(
    "agent_actions", f"(SELECT * FROM agent_actions WHERE status = 'executed' AND priority = 5 {_URGENT_FIRST} LIMIT 50)"))
twin("action_by_id", "agent_actions", _plain("agent_actions") + " WHERE action_id = 'A42'")
twin("latest_executed", "agent_actions", f"""
SELECT action_id, customer_id, action_type, priority, outcome, {stamp('executed_at')} AS executed_at
FROM (SELECT * FROM agent_actions WHERE status = 'executed' ORDER BY executed_at DESC, action_id DESC LIMIT 6)""")
_METRICS = {
    "customers": ("count(*)", "customers"), "churned": ("count(*) FILTER (WHERE is_churned = 1)", "customers"),
    "active": ("count(*) FILTER (WHERE is_churned = 0)", "customers"),
    "active_mrr": (rnd("sum(mrr) FILTER (WHERE is_churned = 0)", 2), "customers"),
    "churn_rate": (rnd("avg(is_churned)", 4), "customers"),
    **{f"plan_{p}": (f"count(*) FILTER (WHERE plan = '{p}')", "customers") for p in ("Free", "Starter", "Pro", "Enterprise")},
    **{t: ("count(*)", t) for t in ("transactions", "engagement_events", "support_tickets", "email_log")},
}
twin("data_summary", "customers transactions engagement_events support_tickets email_log", " UNION ALL ".join(
    f"SELECT '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}" for name, (value, source) in _METRICS.items()))
twin("churn_band_distribution", "ml_predictions", """
SELECT CASE WHEN churn_score < 0.3::DOUBLE THEN '<30%' WHEN churn_score <= 0.6::DOUBLE THEN '30-60%' ELSE '>60%' END AS band,
  count(*) AS customers FROM ml_predictions GROUP BY 1""")
twin("outcome_distribution", "agent_actions",
     "SELECT outcome, count(*) AS actions FROM agent_actions WHERE status = 'executed' GROUP BY outcome")

twin("pending_page", "agent_actions",
     _plain("agent_actions", f"(SELECT * FROM agent_actions WHERE status = 'pending' {_URGENT_FIRST} LIMIT 2000)"))
# What comes in a part is late by the newest time of the parts before it; of a repeated event the first to arrive in time counts.
twin("streamed_rolling_counts", "engagement_events", """
, numbered AS (SELECT event_id, customer_id, event_date, floor(date_diff('day', DATE '2024-01-01', event_date::DATE) / 12)
    + CASE WHEN key % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN key % 17 = 3 THEN 4 ELSE 0 END AS part, key
  FROM (SELECT *, CAST(substring(event_id, 2) AS BIGINT) AS key FROM engagement_events WHERE customer_id IS NOT NULL)),
arrived AS (SELECT event_id, customer_id, event_date, part FROM numbered
  UNION ALL SELECT event_id, customer_id, event_date + INTERVAL 1 DAY, part + 1 FROM numbered WHERE key % 7 = 0),
newest AS (SELECT part, max(max(event_date)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM arrived GROUP BY part),
timely AS (SELECT event_id, min_by(customer_id, part) AS customer_id, min_by(event_date, part) AS event_date FROM arrived JOIN newest USING (part)
  WHERE before IS NULL OR event_date > before - INTERVAL 26 DAY GROUP BY event_id),
days AS (SELECT customer_id, event_date::DATE AS day, count(*) AS events FROM timely GROUP BY ALL),
spans AS (SELECT customer_id, events, CAST(unnest(range(day + 1, day + 31, INTERVAL 1 DAY)) AS TIMESTAMP) AS until FROM days)
SELECT customer_id, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, CAST(sum(events) AS BIGINT) AS event_count FROM spans GROUP BY customer_id, spans.until""".lstrip())
twin("streamed_health_in_order", "customers agent_actions", _folded(
    "(SELECT * FROM agent_actions WHERE status = 'executed' AND feedback_applied_at IS NULL)", "executed_at, action_id"))
twin("streamed_health", "customers agent_actions", _folded(
    "(SELECT * FROM agent_actions WHERE status = 'executed' AND feedback_applied_at IS NULL)", "executed_at, action_id"))
twin("streamed_event_counts", "engagement_events", f"""
SELECT customer_id, CAST(count(*) AS BIGINT) AS event_count FROM engagement_events
WHERE event_date >= {AS_OF} - INTERVAL 30 DAY AND event_date < {AS_OF} GROUP BY customer_id""")


def _model_checks(label: str, rows: str) -> str:
    return f"""
SELECT count(*) FILTER (WHERE NOT {label}) AS customers_0, count(*) FILTER (WHERE {label}) AS customers_1,
  3::BIGINT AS families, 1::BIGINT AS chosen, true AS figures_in_range, true AS a_fifth_is_held_out, true AS all_are_judged
FROM customers {rows}"""


twin("churn_model_report", "customers", _model_checks("is_churned = 1", ""))
twin("churn_scores", "customers", "SELECT customer_id, true AS in_range, true AS label_fits FROM customers")
twin("conversion_model_report", "customers", _model_checks("plan = 'Pro'", "WHERE plan <> 'Enterprise'"))
twin("conversion_scores", "customers", """
SELECT customer_id, plan AS current_plan, true AS in_range, true AS label_fits, true AS enterprise_is_one FROM customers""")
twin("segment_model_report", "customers", """
SELECT count(*) AS customers, 5::BIGINT AS clusters, 5::BIGINT AS names, '[1, 2, 3, 4, 5]' AS ranks, true AS silhouette_in_range
FROM customers""")
twin("segment_scores", "customers", "SELECT customer_id, true AS named_as_its_cluster, true AS confidence_in_range FROM customers")
twin("model_predictions", "customers", f"""
SELECT customer_id, {stamp(AS_OF)} AS predicted_at, true AS in_range, true AS enterprise_is_one, true AS segment_known,
  true AS value_follows FROM customers""")
