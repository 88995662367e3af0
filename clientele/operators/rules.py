"""Business rules as column expressions: one pass over the customers, no shuffle."""

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions import fixed_text, literal_map, percent_text, whole_text
from clientele.schemas import PRIORITY_LABELS
from clientele.sources.tables import latest_predictions

CANDIDATE_COLUMNS = (
    "customer_id", "action_type", "reason", "priority", "rule_id", "rule_order", "triggered_by", "context",
)


@dataclass(frozen=True)
class Rule:
    """One rule. The callables build columns over an enriched customer row.

    ``signals`` are the columns kept as evidence; ``emits`` overrides the priority
    written to the candidates, which :func:`priority_mismatches` then reports.
    """

    rule_id: str
    priority: int
    action_type: str
    when: Callable[[], Column]
    reason: Callable[[], Column]
    signals: tuple[str, ...]
    context: dict[str, Callable[[], Column]] = field(default_factory=dict)
    emits: int | None = None


REGISTRY: list[Rule] = []


def register(rule: Rule, registry: list[Rule] | None = None) -> Rule:
    """Add a rule at the end of a registry; the order breaks ties between equal priorities."""
    rules = REGISTRY if registry is None else registry
    if any(r.rule_id == rule.rule_id for r in rules):
        raise ValueError(f"rule {rule.rule_id} is registered already")
    rules.append(rule)
    return rule


c = F.col


def _between(score: str, low: float, high: float) -> Column:
    return (c(score) >= low) & (c(score) < high)


register(Rule(
    "CHN-001", 5, "escalate_to_csm",
    when=lambda: (c("churn_score") >= 0.80) & (c("mrr") >= 100),
    reason=lambda: F.concat(
        F.lit("Churn probability "), percent_text(c("churn_score")), F.lit(" while paying $"),
        whole_text(c("mrr")), F.lit(" a month: success manager to step in now"),
    ),
    signals=("churn_score", "mrr", "segment"),
))
register(Rule(
    "CHN-002", 4, "send_retention_email",
    when=lambda: _between("churn_score", 0.55, 0.80),
    reason=lambda: F.concat(
        F.lit("Churn probability "), percent_text(c("churn_score")), F.lit(" in segment "),
        c("segment"), F.lit(": offer a reason to stay"),
    ),
    signals=("churn_score", "segment", "health_score"),
))
register(Rule(
    "CHN-003", 3, "send_reengagement_email",
    when=lambda: (c("days_since_last_event") >= 30) & (c("churn_score") >= 0.35),
    reason=lambda: F.concat(
        F.lit("Silent for "), c("days_since_last_event").cast("string"), F.lit(" days with churn probability "),
        percent_text(c("churn_score")), F.lit(": invite back"),
    ),
    signals=("days_since_last_event", "churn_score", "event_count_30d"),
))
register(Rule(
    "CHN-004", 4, "proactive_support_call",
    when=lambda: (c("cancellation_risk") >= 1) | ((c("avg_sentiment") < -0.4) & (c("ticket_count") >= 2)),
    reason=lambda: F.concat(
        c("cancellation_risk").cast("string"), F.lit(" cancellation tickets, mean sentiment "),
        fixed_text(c("avg_sentiment"), 2), F.lit(": call before they do"),
    ),
    signals=("cancellation_risk", "avg_sentiment", "open_tickets"),
))
register(Rule(
    "CNV-001", 4, "send_upgrade_offer",
    when=lambda: (c("conversion_score") >= 0.70) & (c("plan_rank") <= 1),
    reason=lambda: F.concat(
        F.lit("Upgrade probability "), percent_text(c("conversion_score")), F.lit(" on plan "),
        F.coalesce(c("plan"), F.lit("unknown")), F.lit(": make an offer"),
    ),
    signals=("conversion_score", "plan", "engagement_index"),
    context={"suggested_plan": lambda: F.when(c("plan_rank") == 1, "Pro").otherwise("Starter")},
))
register(Rule(
    "CNV-002", 2, "enroll_nurture_sequence",
    when=lambda: _between("conversion_score", 0.40, 0.70) & (c("plan_rank") == 0),
    reason=lambda: F.concat(
        F.lit("Free user with upgrade probability "), percent_text(c("conversion_score")),
        F.lit(": show the value step by step"),
    ),
    signals=("conversion_score", "plan", "tenure_days"),
))
register(Rule(
    "CNV-003", 3, "send_upgrade_offer",
    when=lambda: (c("plan_rank") == 1) & (c("event_count_30d") >= 20) & (c("conversion_score") >= 0.50),
    reason=lambda: F.concat(
        F.lit("Starter customer with "), c("event_count_30d").cast("string"),
        F.lit(" events in 30 days: outgrowing the plan"),
    ),
    signals=("event_count_30d", "conversion_score", "plan"),
    context={"suggested_plan": lambda: F.lit("Pro")},
))
register(Rule(
    "LYL-001", 2, "send_loyalty_reward",
    when=lambda: (c("segment") == "Champion") & (c("tenure_days") >= 180),
    reason=lambda: F.concat(
        F.lit("Champion for "), c("tenure_days").cast("string"), F.lit(" days: say thank you"),
    ),
    signals=("segment", "tenure_days", "health_score"),
))
register(Rule(
    "LYL-002", 1, "send_health_checkin",
    when=lambda: (c("health_score") < 35) & (c("churn_score") < 0.45),
    reason=lambda: F.concat(
        F.lit("Health down to "), whole_text(c("health_score")), F.lit(" of 100, churn still unlikely: ask how it goes"),
    ),
    signals=("health_score", "churn_score", "nps_score"),
))


def enrich(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Features with scores; a customer without a prediction scores 0 in segment Unknown.

    Churned customers stay in.
    """
    joined = features.join(latest_predictions(predictions), "customer_id", "left")
    return joined.na.fill(0.0, ["churn_score", "conversion_score", "ltv_estimate"]).na.fill(
        "Unknown", ["segment"]
    )


def _candidate(rule: Rule, order: int) -> Column:
    """The candidate of one rule, null where the rule does not fire."""
    context = (
        F.to_json(F.struct(*[make().alias(name) for name, make in rule.context.items()]))
        if rule.context
        else F.lit("{}")
    )
    candidate = F.struct(
        F.lit(rule.action_type).alias("action_type"),
        rule.reason().alias("reason"),
        F.lit(rule.priority if rule.emits is None else rule.emits).alias("priority"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(order).alias("rule_order"),
        F.to_json(F.struct(*rule.signals)).alias("triggered_by"),
        context.alias("context"),
    )
    return F.when(rule.when(), candidate)


def fire_rules(enriched: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Customers that fire at least one rule, with their candidates as an array in rule order.

    The array is as long as the registry at most. Keeping it next to the customer
    lets the planning steps resolve it row by row, without regrouping.
    """
    rules = REGISTRY if rules is None else rules
    fired = F.array_compact(F.array(*[_candidate(r, i) for i, r in enumerate(rules)]))
    return enriched.withColumn("candidates", fired).filter(F.size("candidates") > 0)


def evaluate_rules(enriched: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per fired rule and customer."""
    return fire_rules(enriched, rules).select("customer_id", F.inline("candidates"))


def evaluate_python_rule(
    enriched: DataFrame,
    rule_id: str,
    priority: int,
    rule: Callable[[dict], dict | None],
    columns: Sequence[str],
    rule_order: int = 1000,
) -> DataFrame:
    """Candidates of a rule that only Python can express.

    ``rule`` sees one row as a dict of ``columns`` (a null is None) and returns ``action_type``,
    ``reason`` and optionally ``priority``, ``triggered_by`` and ``context`` as JSON text, or None.
    The workers must be able to import its module, unless it is a local function.
    A row on which it fails, or returns something of another type, becomes an output row with ``error`` set and no
    action. It runs row by row in Python: what column functions can express belongs in the registry of rules.
    """
    names = ["customer_id", *[n for n in columns if n != "customer_id"]]

    kinds = {
        "customer_id": str, "action_type": str, "reason": str, "priority": int, "rule_id": str, "rule_order": int,
        "triggered_by": str, "context": str, "error": str,
    }
    arrow = pa.schema([(name, pa.int32() if kind is int else pa.string()) for name, kind in kinds.items()])

    def checked(result: dict) -> dict:
        for name, value in result.items():
            if name not in kinds or value is not None and (type(value) is not kinds[name]):
                raise TypeError(f"{name} is {type(value).__name__}")
        return result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                base = {
                    "customer_id": row["customer_id"], "action_type": None, "reason": None,
                    "priority": priority, "rule_id": rule_id, "rule_order": rule_order,
                    "triggered_by": "{}", "context": "{}", "error": None,
                }
                try:
                    result = rule(row)
                    result = result if result is None else checked(result)
                except Exception as error:  # one bad row must not end the job
                    found.append({**base, "error": f"{type(error).__name__}: {error}"})
                    continue
                if result is not None:
                    found.append({**base, **result})
            yield pa.RecordBatch.from_pylist(found, arrow)

    schema = (
        "customer_id string, action_type string, reason string, priority int, rule_id string,"
        " rule_order int, triggered_by string, context string, error string"
    )
    return enriched.select(*names).mapInArrow(run, schema)


_RULE_ROW = {
    "customer_id": "string", "action_type": "string", "reason": "string", "priority": "int", "rule_id": "string",
    "rule_order": "int", "triggered_by": "string", "context": "string", "error": "string",
}
_FROM_RULE = {"action_type": str, "reason": str, "priority": int, "triggered_by": str, "context": str}


def evaluate_batch_rule(
    enriched: DataFrame,
    rule_id: str,
    priority: int,
    rule: Callable[[pd.DataFrame], pd.DataFrame | None],
    columns: Sequence[str],
    rule_order: int = 1000,
) -> DataFrame:
    """Candidates of a rule over pandas batches: vectorized, and still one bad row costs only itself.

    ``rule`` sees a frame with customer_id and ``columns`` (whole numbers with nulls come as ``Int64``) and returns a frame with the index of
    the rows that fire: ``action_type``, ``reason`` and optionally ``priority``, ``triggered_by`` and ``context``.
    It must judge each row by itself, as batches are cut anywhere. Where it raises, or returns rows it was not given or values of another
    type, the batch is halved until the row is alone; that row becomes an output row with ``error`` set. A batch with k such rows
    of n is run about 2 k log2(n / k) times more.
    """
    names = ["customer_id", *[n for n in columns if n != "customer_id"]]
    arrow = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in _RULE_ROW.items()])
    rule_kinds = dict(_FROM_RULE)
    whole_types = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}

    def fired(part: pd.DataFrame) -> list[dict]:
        result = rule(part.copy())
        if result is None or not len(result):
            return []
        if not result.index.is_unique or not result.index.isin(part.index).all():
            raise ValueError("the rule returned rows it was not given")
        rows = []
        for at, values in zip(result.index, result.to_dict("records")):
            row = {
                "customer_id": part.at[at, "customer_id"], "action_type": None, "reason": None, "priority": priority,
                "rule_id": rule_id, "rule_order": rule_order, "triggered_by": "{}", "context": "{}", "error": None,
            }
            for name, value in values.items():
                if name not in rule_kinds:
                    raise TypeError(f"{name} is no column of a candidate")
                value = value.item() if hasattr(value, "item") else value
                if value is not None and value == value:
                    if type(value) is not rule_kinds[name]:
                        raise TypeError(f"{name} is {type(value).__name__}")
                    row[name] = value
            rows.append(row)
        return rows

    def halved(part: pd.DataFrame) -> list[dict]:
        rows, waiting = [], [part]
        while waiting:
            now = waiting.pop()
            try:
                rows += fired(now)
            except Exception as error:  # one bad row must not end the job
                if len(now) == 1:
                    rows.append({
                        "customer_id": now["customer_id"].iloc[0], "action_type": None, "reason": None, "priority": priority, "rule_id": rule_id,
                        "rule_order": rule_order, "triggered_by": "{}", "context": "{}", "error": f"{type(error).__name__}: {error}",
                    })
                else:
                    waiting += [now.iloc[len(now) // 2 :], now.iloc[: len(now) // 2]]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist(halved(batch.to_pandas(types_mapper=whole_types.get)), arrow)

    return enriched.select(*names).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _RULE_ROW.items()))


@contextmanager
def _null_for_errors(df: DataFrame):
    """Expressions analyzed here give null where they would end the job (a division by zero, a cast of a wrong text, an overflow)."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        conf.set("spark.sql.ansi.enabled", before)


def evaluate_rules_apart(enriched: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """As :func:`evaluate_rules`, with an ``error`` column: a rule that fails on a row costs that row and rule, not the job.

    Rules are analyzed so that a failing expression is null. A rule that cannot tell on a row (its condition is null although the columns
    in its ``signals`` are not), or that fires with a reason or context it cannot form, gives a row with ``error`` and no action. A
    condition that is null because a signal is null does not fire, as always. All other rules of the row are not touched.
    """
    rules = REGISTRY if rules is None else rules
    with _null_for_errors(enriched):
        judged = [
            F.struct(
                rule.when().alias("fires"),
                (rule.when().isNull() & F.concat(*[F.col(s).cast("string") for s in rule.signals]).isNotNull()).alias("unknown"),
                rule.reason().alias("reason"),
                F.lit(rule.action_type).alias("action_type"),
                F.lit(rule.priority if rule.emits is None else rule.emits).alias("priority"),
                F.lit(rule.rule_id).alias("rule_id"), F.lit(order).alias("rule_order"),
                F.to_json(F.struct(*rule.signals)).alias("triggered_by"),
                (F.to_json(F.struct(*[make().alias(n) for n, make in rule.context.items()])) if rule.context else F.lit("{}")).alias("context"),
            )
            for order, rule in enumerate(rules)
        ]
        rows = enriched.select("customer_id", F.inline(F.filter(F.array(*judged), lambda x: x["fires"] | x["unknown"])))
    error = F.when(F.col("unknown"), "the condition cannot be computed").when(F.col("reason").isNull(), "the reason cannot be computed")
    return rows.withColumn("error", error).select(
        "customer_id", F.when(error.isNull(), F.col("action_type")).alias("action_type"), F.when(error.isNull(), F.col("reason")).alias("reason"),
        "priority", "rule_id", "rule_order", "triggered_by", "context", "error",
    )


def priority_mismatches(candidates: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Rules whose candidates carry another priority than the registry states."""
    rules = REGISTRY if rules is None else rules
    expected = literal_map({r.rule_id: r.priority for r in rules}, F.col("rule_id"))
    return (
        candidates.withColumn("expected", expected)
        .filter("expected <> priority")
        .groupBy("rule_id", "expected", F.col("priority").alias("emitted"))
        .agg(F.count(F.lit(1)).alias("candidates"))
    )


def rule_summary(candidates: DataFrame) -> DataFrame:
    """Candidates per action, per priority and per rule, from one shuffle of small counts."""
    counts = candidates.groupBy("action_type", "priority", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    label = literal_map(PRIORITY_LABELS, F.col("priority"))
    priority = F.concat(
        F.lit("P"), F.col("priority").cast("string"), F.lit(" "), F.coalesce(label, F.col("priority").cast("string"))
    )
    sides = counts.select(
        "n",
        F.inline(
            F.array(
                F.struct(F.lit("action").alias("kind"), F.col("action_type").alias("value")),
                F.struct(F.lit("priority").alias("kind"), priority.alias("value")),
                F.struct(F.lit("rule").alias("kind"), F.col("rule_id").alias("value")),
            )
        ),
    )
    return sides.groupBy("kind", "value").agg(F.sum("n").alias("candidates"))
