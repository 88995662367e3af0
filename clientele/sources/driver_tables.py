"""The seven tables and the outside decisions, derived from the driver's Parquet tables.

The mapping is written down in FIXTURES.md; the SQL twin is in ``checks/oracle_sql.py``.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.schemas import ACTIONABLE_TYPES, HEALTH_DELTAS, TABLES
from clientele.sources.tables import conform

AS_OF = "2024-02-10 00:00:00"
ACTIONS_AS_OF = "2024-01-31 00:00:00"

# Fixed values of the mapping.
SHIFT = "INTERVAL '8200' DAY"
EMPLOYEE_COUNTS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
CHANNELS = ("Email", "SMS", "Push", "In-App", "Sales Call")
TOPICS = ("billing", "technical", "onboarding", "feature_request")
EMAIL_TYPES = ("welcome", "nurture", "re_engagement", "upsell", "retention")
FIXTURE_SEGMENTS = ("Champion", "Loyal", "At-Risk", "Prospect", "Lost")
# Outcome slots of the fixture, the last one being no outcome at all.
OUTCOME_SLOTS = (*HEALTH_DELTAS, "completed", None)


def _cid(key: str) -> str:
    return f"concat('C', lpad(cast({key} AS string), 7, '0'))"


def _pick(values: Iterable, index: str) -> str:
    """Element of a constant list at a 0-based index."""
    items = ", ".join(
        "NULL" if v is None else str(v) if isinstance(v, int) else "r'" + v + "'" for v in values
    )
    return f"element_at(array({items}), cast({index} AS int) + 1)"


_PLAN = (
    "CASE WHEN c_custkey % 20 < 6 THEN 'Free' WHEN c_custkey % 20 < 13 THEN 'Starter'"
    " WHEN c_custkey % 20 < 18 THEN 'Pro' ELSE 'Enterprise' END"
)
_MRR = (
    "(CASE WHEN c_custkey % 20 < 6 THEN 0D WHEN c_custkey % 20 < 13 THEN 49D"
    " WHEN c_custkey % 20 < 18 THEN 199D ELSE 999D END) * (0.9D + cast(c_custkey % 51 AS double) / 100D)"
)


def _score(factor: int) -> str:
    return f"rint(cast(c_custkey * {factor} % 10007 AS double) / 10007D * 10000D) / 10000D"


_EVENT_CUSTOMER = _cid(
    "(user_id * 10 + 2 * (user_id % 5) + CASE WHEN day(ts) <= 10 AND event_id % 2 = 0 THEN 1 ELSE 0 END)"
)
_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS int))"
_TICKET_STATUS = (
    "CASE WHEN l_suppkey % 20 < 3 THEN 'open' WHEN l_suppkey % 20 < 5 THEN 'in_progress'"
    " WHEN l_suppkey % 20 < 18 THEN 'resolved' ELSE 'escalated' END"
)
_NOW = f"TIMESTAMP_NTZ '{AS_OF}'"

# Source files (with their join condition), filter, and the columns of each table.
_MAPPING: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    "customers": (
        ("customer", "nation", "c_nationkey = n_nationkey"),
        "true",
        (
            f"{_cid('c_custkey')} AS customer_id",
            "c_name AS name",
            "concat('customer', c_custkey, '@example.com') AS email",
            "concat('Company ', c_custkey) AS company",
            "c_mktsegment AS industry",
            f"{_PLAN} AS plan",
            f"{_MRR} AS mrr",
            f"{_NOW} - make_dt_interval(cast(30 + c_custkey * 37 % 701 AS int)) AS signup_date",
            "n_name AS country",
            f"{_pick(EMPLOYEE_COUNTS, 'c_custkey % 9')} AS employee_count",
            "least(greatest((c_acctbal + 1000D) / 110D, 0D), 100D) AS health_score",
            "cast(c_custkey * 13 % 201 - 100 AS int) AS nps_score",
            "cast(c_custkey % 5 = 0 AS int) AS is_churned",
            f"CASE WHEN c_custkey % 5 = 0 THEN {_NOW} - INTERVAL '10' DAY END AS churn_date",
            f"{_NOW} AS created_at",
        ),
    ),
    "transactions": (
        ("orders",),
        "true",
        (
            "concat('T', o_orderkey) AS txn_id",
            f"{_cid('o_custkey')} AS customer_id",
            "CASE WHEN o_orderkey % 20 < 19 THEN o_totalprice / 1000D ELSE -(o_totalprice / 1000D) END AS amount",
            "'USD' AS currency",
            "CASE WHEN o_orderkey % 20 < 8 THEN 'purchase' WHEN o_orderkey % 20 < 16 THEN 'renewal'"
            " WHEN o_orderkey % 20 < 19 THEN 'upgrade' ELSE 'refund' END AS txn_type",
            "concat('P', o_orderkey % 30) AS product_id",
            "CASE WHEN o_orderstatus <> 'P' THEN 'completed' WHEN o_orderpriority = '1-URGENT' THEN 'refunded'"
            " ELSE 'failed' END AS status",
            f"o_orderdate + {SHIFT} AS txn_date",
        ),
    ),
    "engagement_events": (
        ("events",),
        "true",
        (
            "concat('E', event_id) AS event_id",
            f"{_EVENT_CUSTOMER} AS customer_id",
            "event_type",
            f"{_pick(CHANNELS, "cast(get_json_object(props, '$.k') AS int) % 5")} AS channel",
            "cast(30 + floor(value * 10D) AS int) AS session_duration",
            "ts AS event_date",
            "props AS metadata",
        ),
    ),
    "support_tickets": (
        ("lineitem", "orders", "l_orderkey = o_orderkey"),
        "l_returnflag = 'R'",
        (
            f"concat('TK', {_LINE_ID}) AS ticket_id",
            f"{_cid('o_custkey')} AS customer_id",
            f"CASE WHEN l_partkey % 60 = 0 THEN 'cancellation' ELSE {_pick(TOPICS, 'l_partkey % 4')} END AS topic",
            f"{_TICKET_STATUS} AS status",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'"
            " WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority",
            "1D - l_tax * 25D AS sentiment_score",
            f"l_shipdate + {SHIFT} AS opened_at",
            f"CASE WHEN {_TICKET_STATUS} = 'resolved' THEN l_shipdate + {SHIFT} + INTERVAL '3' DAY END AS resolved_at",
        ),
    ),
    "email_log": (
        ("lineitem", "orders", "l_orderkey = o_orderkey"),
        "l_returnflag <> 'R'",
        (
            f"concat('EM', {_LINE_ID}) AS email_id",
            f"{_cid('o_custkey')} AS customer_id",
            f"{_pick(EMAIL_TYPES, 'l_partkey % 5')} AS email_type",
            f"{_pick(EMAIL_TYPES, 'l_partkey % 5')} AS subject",
            "cast(l_quantity <= 17 AS int) AS opened",
            "cast(l_quantity <= 17 AND l_linenumber = 1 AS int) AS clicked",
            f"l_shipdate + {SHIFT} AS sent_at",
        ),
    ),
    "agent_actions": (
        ("events",),
        "true",
        (
            "concat('A', event_id) AS action_id",
            f"{_EVENT_CUSTOMER} AS customer_id",
            f"{_pick(ACTIONABLE_TYPES, 'event_id % 8')} AS action_type",
            "'fixture' AS reason",
            "cast(event_id % 5 + 1 AS int) AS priority",
            "CASE WHEN event_id % 3 <> 0 THEN 'executed' ELSE 'pending' END AS status",
            f"CASE WHEN event_id % 3 <> 0 THEN {_pick(OUTCOME_SLOTS, 'event_id div 8 % 24')} END AS outcome",
            "ts - INTERVAL '1' HOUR AS created_at",
            "CASE WHEN event_id % 3 <> 0 THEN ts - make_dt_interval(0, 0, 0,"
            " cast(extract(SECOND FROM ts) % 1 AS decimal(8, 6))) END AS executed_at",
            """CASE WHEN event_id % 7 = 0 THEN '{"context":{"suggested_plan":"Pro"}}'"""
            " WHEN event_id % 7 = 1 THEN '{not json' END AS metadata",
            "cast(event_id % 5 + 1 AS double) * 3D + 1.05D + cast(event_id % 200 AS double) / 100D AS urgency_score",
            "CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN ts END AS feedback_applied_at",
        ),
    ),
    "ml_predictions": (
        ("customer",),
        "true",
        (
            "concat('PR', c_custkey) AS prediction_id",
            f"{_cid('c_custkey')} AS customer_id",
            f"{_score(7919)} AS churn_score",
            f"CASE WHEN c_custkey % 20 >= 18 THEN 1D ELSE {_score(3571)} END AS conversion_score",
            f"{_pick(FIXTURE_SEGMENTS, 'c_custkey % 7 % 5')} AS segment",
            f"rint({_MRR} * (1D - {_score(7919)}) * 24D * 100D) / 100D AS ltv_estimate",
            f"{_NOW} AS predicted_at",
        ),
    ),
}


class _Sources:
    """The driver's files, each opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.opened = spark, sf_dir, {}

    def read(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.opened[name]

    def table(self, name: str) -> DataFrame:
        """One table; Catalyst pushes the filter and the column choice into the scans."""
        files, condition, columns = _MAPPING[name]
        rows = self.read(files[0])
        if len(files) > 1:
            rows = rows.join(self.read(files[1]), F.expr(files[2]))
        return conform(rows.filter(condition).selectExpr(*columns), TABLES[name])


def crm_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _Sources(spark, sf_dir).table(name)


def crm_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    sources = _Sources(spark, sf_dir)
    return {name: sources.table(name) for name in names}


# One response text per kind of answer.
_VALID = (
    '{"action_type": " send_health_checkin ", "reason": "Quiet account, ask first", '
    '"priority": "3", "confidence": 0.85, "notes": "soft tone"}'
)
RESPONSES = (
    _VALID,
    "```json\n" + _VALID + "\n```",
    '{"action_type": "send_flowers", "priority": 2}',
    '{"action_type": "no_action"}',
    '{"action_type": "escalate_to_csm", "reason": "Large account", "priority": 99, "confidence": 5}',
    '{"action_type": "proactive_support_call", "reason": "  ", "priority": 2, "confidence": "abc"}',
    "sorry, I cannot help",
)


def decision_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside answers for every eleventh customer, in seven kinds."""
    rows = _Sources(spark, sf_dir).read("customer").filter("c_custkey % 11 = 0")
    return rows.selectExpr(f"{_cid('c_custkey')} AS customer_id", f"{_pick(RESPONSES, 'c_custkey % 7')} AS response")
