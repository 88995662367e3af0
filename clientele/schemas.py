"""Table schemas and the fixed vocabularies of the data model."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "timestamp_ntz": T.TimestampNTZType()}


def _schema(ddl: str) -> T.StructType:
    """Schema from DDL text, read without a session; the first column is the primary key."""
    columns = [column.split() for column in ddl.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], nullable=n > 0) for n, (name, kind) in enumerate(columns)])


# Column names and types of the seven tables.
TABLES: dict[str, T.StructType] = {
    "customers": _schema(
        "customer_id string, name string, email string, company string, industry string, plan string, "
        "mrr double, signup_date timestamp_ntz, country string, employee_count int, health_score double, "
        "nps_score int, is_churned int, churn_date timestamp_ntz, created_at timestamp_ntz"
    ),
    "transactions": _schema(
        "txn_id string, customer_id string, amount double, currency string, txn_type string, "
        "product_id string, status string, txn_date timestamp_ntz"
    ),
    "engagement_events": _schema(
        "event_id string, customer_id string, event_type string, channel string, session_duration int, "
        "event_date timestamp_ntz, metadata string"
    ),
    "support_tickets": _schema(
        "ticket_id string, customer_id string, topic string, status string, priority string, "
        "sentiment_score double, opened_at timestamp_ntz, resolved_at timestamp_ntz"
    ),
    "email_log": _schema(
        "email_id string, customer_id string, email_type string, subject string, opened int, clicked int, "
        "sent_at timestamp_ntz"
    ),
    "agent_actions": _schema(
        "action_id string, customer_id string, action_type string, reason string, priority int, "
        "status string, outcome string, created_at timestamp_ntz, executed_at timestamp_ntz, "
        "metadata string, urgency_score double, feedback_applied_at timestamp_ntz"
    ),
    "ml_predictions": _schema(
        "prediction_id string, customer_id string, churn_score double, conversion_score double, "
        "segment string, ltv_estimate double, predicted_at timestamp_ntz"
    ),
}

PRIMARY_KEYS = {name: schema.fields[0].name for name, schema in TABLES.items()}
FACT_TABLES = tuple(name for name in TABLES if name != "customers")

# Plan tiers, lowest first; the position is the plan rank.
PLANS = ("Free", "Starter", "Pro", "Enterprise")

# Segment names, best cluster first.
SEGMENTS = ("Champion", "Loyal", "At-Risk", "Prospect", "Lost")

# Every action a plan may carry, with its cooldown in days.
COOLDOWN_DAYS = {
    "escalate_to_csm": 3,
    "send_retention_email": 7,
    "send_reengagement_email": 14,
    "send_upgrade_offer": 10,
    "enroll_nurture_sequence": 30,
    "proactive_support_call": 5,
    "send_loyalty_reward": 90,
    "send_health_checkin": 14,
    "no_action": 0,
}
DEFAULT_COOLDOWN_DAYS = 7
COOLDOWN_HORIZON_DAYS = 90
NO_ACTION = "no_action"
ACTION_TYPES = tuple(COOLDOWN_DAYS)
ACTIONABLE_TYPES = tuple(a for a in ACTION_TYPES if a != NO_ACTION)

# What one outcome does to a customer's health score.
HEALTH_DELTAS = {
    "opened_clicked": 3.0,
    "discount_redeemed": 5.0,
    "logged_in": 4.0,
    "upgraded": 10.0,
    "reward_claimed": 4.0,
    "replied_positive": 5.0,
    "call_completed_retained": 8.0,
    "issue_resolved": 6.0,
    "enrolled_active": 3.0,
    "scheduled_followup": 1.0,
    "callback_scheduled": 1.0,
    "opened_only": 1.0,
    "clicked_not_converted": 0.5,
    "enrolled_passive": 0.5,
    "no_response": -1.0,
    "no_answer": -0.5,
    "bounced": -0.5,
    "unsubscribed": -5.0,
    "call_completed_churned": -10.0,
    "replied_negative": -3.0,
    "already_enrolled": 0.0,
    "escalated_csm": -1.0,
}

# Outcome classes; any other label is neutral.
SUCCESS_OUTCOMES = (
    "opened_clicked", "discount_redeemed", "logged_in", "upgraded", "reward_claimed",
    "replied_positive", "call_completed_retained", "issue_resolved", "enrolled_active",
    "enrolled_passive", "replied_negative",
)
FAILURE_OUTCOMES = (
    "unsubscribed", "bounced", "call_completed_churned", "no_response", "no_answer",
    "already_enrolled",
)
# Outcomes of an email that was not opened / that was clicked.
UNOPENED_OUTCOMES = ("no_response", "bounced", "unsubscribed")
CLICKED_OUTCOMES = (
    "opened_clicked", "upgraded", "discount_redeemed", "reward_claimed", "logged_in",
)

PRIORITY_LABELS = {5: "CRITICAL", 4: "HIGH", 3: "MEDIUM", 2: "LOW", 1: "INFO"}
