"""The registered queries: every operator run over the driver's whole tables.

Each takes (spark, folder) and returns a DataFrame. Times are given as text, and
columns are named as in the SQL twin.
"""

import hashlib
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.functions import discount_code, half_even, short_money
from clientele.operators import daily as dly
from clientele.operators import features as feat
from clientele.operators import feedback as fb
from clientele.operators import outcomes as out
from clientele.operators import queue as que
from clientele.operators import reports as rep
from clientele.operators import rules as rul
from clientele.operators import scoring as sco
from clientele.operators import segments as seg
from clientele.operators import training as trn
from clientele.operators.messages import render_messages, suggested_plan
from clientele.operators.model_store import load_or_train
from clientele.operators.skew import join_profiles
from clientele.plans import planner as pln
from clientele.plans.cycle import Cycle, cycle_summary, decision_cycle
from clientele.plans.execution import run_execution, run_feedback
from clientele.plans.inference import Models, run_inference, stored_features
from clientele.schemas import TABLES
from clientele.session import scratch_path, shared_dir, stored
from clientele.sources import sinks
from clientele.sources.constraints import check_constraints
from clientele.sources.driver_tables import (
    ACTIONS_AS_OF, AS_OF, crm_table, crm_tables, decision_responses,
)
from clientele.sources.merge import replace_pending, upsert_by_key
from clientele.sources.tables import conform, latest_predictions, load_table
from clientele.streaming.engagement import daily_counts, rolling_counts, start_engagement
from clientele.streaming.feedback import current_health, start_feedback
from clientele.streaming.windows import append_to, appended, ordered_health, ordered_steps, rolling_event_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BUDGET = 30
FEEDBACK_HOURS = 48
ONE_CUSTOMER = "C0000007"
ONE_ACTION = "A42"

# The evidence of the rules beside churn, conversion, segment and tenure.
OTHER_SIGNALS = {
    "mrr": "double", "health_score": "double", "days_since_last_event": "bigint", "event_count_30d": "bigint", "cancellation_risk": "bigint",
    "avg_sentiment": "double", "open_tickets": "bigint", "plan": "string", "engagement_index": "double", "nps_score": "bigint",
}

# Centres for the confidence query, in the order of the scaled signals.
CENTRES = (
    (0.1, 0.2, 0.1, 0.1, 0.5, 0.5),
    (0.9, 0.5, 0.3, 0.4, 0.2, 0.8),
    (0.5, 0.9, 0.7, 0.6, 0.8, 0.2),
    (1.0, 0.1, 0.9, 0.0, 0.9, 0.9),
    (0.3, 0.3, 0.5, 0.9, 0.1, 0.1),
)


def query(function: Query) -> Query:
    """Register a function as the query of its name; time columns become text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        texts = {
            f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
            for f in df.schema.fields
            if isinstance(f.dataType, T.TimestampNTZType)
        }
        return df.withColumns(texts) if texts else df

    QUERIES[function.__name__] = run
    return function


FEATURE_TABLES = ("customers", "transactions", "engagement_events", "support_tickets", "email_log")


def _features(spark, sf_dir):
    return feat.build_customer_features(crm_tables(spark, sf_dir, FEATURE_TABLES), AS_OF)


def _enriched(spark, sf_dir):
    tables = crm_tables(spark, sf_dir, (*FEATURE_TABLES, "ml_predictions"))
    return rul.enrich(feat.build_customer_features(tables, AS_OF), tables["ml_predictions"])


def _sets(spark, sf_dir):
    return pln.fired_sets(rul.fire_rules(_enriched(spark, sf_dir)))


def _resolved(spark, sf_dir):
    """Plans guided by the outside decisions; the sets are stored, as the review reads them too."""
    sets = stored(_sets(spark, sf_dir), "fired-sets")
    return pln.resolve_plans(sets, decision_responses(spark, sf_dir), BUDGET)


def _actions(spark, sf_dir):
    return crm_table(spark, sf_dir, "agent_actions")


def _people_and_scores(spark, sf_dir):
    tables = crm_tables(spark, sf_dir, ("customers", "ml_predictions"))
    return tables["customers"], tables["ml_predictions"]


def _people(spark, sf_dir):
    return crm_table(spark, sf_dir, "customers")


def _scores(spark, sf_dir):
    return crm_table(spark, sf_dir, "ml_predictions")


def _cycle(spark, sf_dir) -> Cycle:
    """Resolved with the outside decisions, scheduled at the end of the action history."""
    tables = crm_tables(spark, sf_dir)
    return decision_cycle(tables, AS_OF, decision_responses(spark, sf_dir), BUDGET, queue_as_of=ACTIONS_AS_OF)


def _key(column: str):
    """The number inside an id."""
    return F.regexp_extract(column, r"(\d+)", 1).cast("bigint")


def _json(column: str, path: str, kind: str = "string"):
    return F.get_json_object(column, path).cast(kind)


# ── sources ──────────────────────────────────────────────────────────────────


def _register_table(name: str) -> None:
    def load(spark, sf_dir):
        return crm_table(spark, sf_dir, name)

    load.__name__ = f"table_{name}"
    query(load)


for _name in TABLES:
    _register_table(_name)


@query
def table_volumes(spark, sf_dir):
    tables = crm_tables(spark, sf_dir)
    counted = [
        tables[name].agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
            F.min(schema.names[0]).alias("first_key"), F.max(schema.names[0]).alias("last_key"),
        )
        for name, schema in TABLES.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def predictions_for_rules(spark, sf_dir):
    return latest_predictions(_scores(spark, sf_dir))


@query
def predictions_rewritten(spark, sf_dir):
    """A second write leaves the new scores only."""
    path = scratch_path(spark, "predictions")
    scores = _scores(spark, sf_dir)
    sinks.write_predictions(scores, path)
    sinks.write_predictions(scores.withColumn("churn_score", 1.0 - F.col("churn_score")), path)
    return conform(spark.read.parquet(path), TABLES["ml_predictions"])


def _new_queue(spark, sf_dir):
    """Pending rows for the executed history: those of the table, renamed."""
    fresh = _actions(spark, sf_dir).filter("status = 'pending'")
    return fresh.withColumn("action_id", F.concat(F.lit("N"), "action_id"))


@query
def pending_replaced(spark, sf_dir):
    return replace_pending(_actions(spark, sf_dir), _new_queue(spark, sf_dir)).select(
        "action_id", "customer_id", "status", "urgency_score"
    )


@query
def pending_rewritten(spark, sf_dir):
    """The same on files: only the pending part of the table is written again."""
    path = scratch_path(spark, "actions")
    sinks.write_actions(_actions(spark, sf_dir), path)
    sinks.write_pending(_new_queue(spark, sf_dir), path)
    return sinks.read_actions(spark, path).select("action_id", "customer_id", "status", "urgency_score")


def _given_outcomes(spark, sf_dir):
    """Outcomes of all actions; where the id is a multiple of five the outcome is unknown (null)."""
    labels = [F.lit(x) for x in ("opened_clicked", "no_response", "upgraded", "issue_resolved", "bounced", "callback_scheduled")]
    key = _key("action_id")
    label = F.when(key % 5 != 0, F.element_at(F.array(*labels), (key % 6).cast("int") + 1))
    return _actions(spark, sf_dir).select("action_id", label.alias("outcome"))


@query
def outcomes_applied(spark, sf_dir):
    return out.apply_outcomes(_actions(spark, sf_dir), _given_outcomes(spark, sf_dir), AS_OF).select(
        "action_id", "customer_id", "status", "outcome", "executed_at"
    )


@query
def outcomes_committed(spark, sf_dir):
    """The same on files, run twice: the second run changes nothing."""
    path, staging = scratch_path(spark, "actions"), scratch_path(spark, "staging")
    actions = _actions(spark, sf_dir)
    sinks.write_actions(actions, path)
    given = _given_outcomes(spark, sf_dir)
    for _ in range(2):
        done = out.apply_outcomes(actions, given, AS_OF).join(
            actions.filter("status = 'pending'").select("action_id"), "action_id", "left_semi"
        )
        sinks.commit_outcomes(spark, path, done.filter("status = 'executed'"), staging)
    return sinks.read_actions(spark, path).select("action_id", "customer_id", "status", "outcome", "executed_at")


def _sent(spark, sf_dir):
    """Executed actions as the mail log sees them."""
    executed = _actions(spark, sf_dir).filter("status = 'executed'")
    channel = F.when(F.col("action_type").startswith("send_"), "email").otherwise("internal_task")
    return executed.withColumns({"channel": channel, "subject": F.concat(F.lit("About "), "action_type")})


@query
def mail_log_rows(spark, sf_dir):
    return out.email_log_rows(_sent(spark, sf_dir))


@query
def mail_log_appended(spark, sf_dir):
    """Appending the same batch twice logs it once."""
    path = scratch_path(spark, "mail")
    conform(crm_table(spark, sf_dir, "email_log"), TABLES["email_log"]).write.parquet(path)
    for _ in range(2):
        sinks.append_email_log(spark, out.email_log_rows(_sent(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query
def customers_upserted(spark, sf_dir):
    """Two versions of every customer, and a new customer for each; the later version wins."""
    people = _people(spark, sf_dir).select("customer_id", "name", "plan", "mrr")
    versions = [
        people.withColumns({"mrr": F.col("mrr") + 10.0 * v, "version": F.lit(v)}) for v in (1, 2)
    ]
    new = people.withColumns({"customer_id": F.concat(F.lit("N"), "customer_id"), "version": F.lit(1)})
    return upsert_by_key(people, versions[1].unionByName(versions[0]).unionByName(new), ["customer_id"], "version")


@query
def legacy_actions_conformed(spark, sf_dir):
    old = _actions(spark, sf_dir).drop("metadata", "urgency_score", "feedback_applied_at")
    return conform(conform(old, TABLES["agent_actions"]), TABLES["agent_actions"])


@query
def constraint_report(spark, sf_dir):
    return check_constraints(crm_tables(spark, sf_dir))


@query
def constraint_violations(spark, sf_dir):
    """The report on damaged tables: lost customers, and copies of events and customers."""
    tables = crm_tables(spark, sf_dir)
    people, events = tables["customers"], tables["engagement_events"]
    copies = people.filter(_key("customer_id") % 7 == 0)
    tables["customers"] = people.filter(_key("customer_id") % 13 != 0).unionByName(copies)
    tables["engagement_events"] = events.unionByName(events.filter(_key("event_id") % 4 == 0))
    return check_constraints(tables)


@query
def transactions_from_csv(spark, sf_dir):
    """A text export with its columns in another order and one of them missing, read back in the declared schema."""
    folder = scratch_path(spark, "export")
    names = ("status", "txn_date", "customer_id", "amount", "product_id", "txn_id", "currency")
    crm_table(spark, sf_dir, "transactions").select(*names).write.option("header", True).csv(f"{folder}/transactions")
    rows = load_table(spark, folder, "transactions", "csv", header="true")
    return rows.select("txn_id", "customer_id", half_even(F.col("amount"), 5).alias("amount"), "status", "txn_date", "txn_type")


# ── features ─────────────────────────────────────────────────────────────────


@query
def customer_base(spark, sf_dir):
    return feat.customer_base(_people(spark, sf_dir), AS_OF).select(
        "customer_id", "plan", "plan_rank", "tenure_days", "mrr", "health_score"
    )


@query
def transaction_features(spark, sf_dir):
    return feat.txn_features(crm_table(spark, sf_dir, "transactions"), AS_OF)


@query
def engagement_features(spark, sf_dir):
    return feat.engagement_features(crm_table(spark, sf_dir, "engagement_events"), AS_OF)


@query
def ticket_features(spark, sf_dir):
    return feat.ticket_features(crm_table(spark, sf_dir, "support_tickets"))


@query
def email_features(spark, sf_dir):
    return feat.email_features(crm_table(spark, sf_dir, "email_log"))


@query
def customer_features(spark, sf_dir):
    return _features(spark, sf_dir).select("customer_id", *feat.feature_columns(), "is_churned", "has_events")


@query
def customer_features_daily(spark, sf_dir):
    """The same features from daily partials; a third of the facts of two days arrives after the first write."""
    tables, path = crm_tables(spark, sf_dir, FEATURE_TABLES), scratch_path(spark, "daily-partials")
    late = ("2024-01-20", "2024-01-21")
    keys = {"transactions": "txn_id", "engagement_events": "event_id", "support_tickets": "ticket_id", "email_log": "email_id"}
    first = {
        fact: tables[fact].filter(~(F.to_date(time).cast("string").isin(*late) & (F.pmod(F.xxhash64(keys[fact]), F.lit(3)) == 0)))
        for fact, time in dly.DAYS.items()
    }
    dly.write_daily(first, path)
    dly.write_daily(tables, path, late)
    features = dly.features_from_daily(spark, tables["customers"], tables["engagement_events"], path, AS_OF)
    return features.select("customer_id", *feat.feature_columns(), "is_churned", "has_events")


@query
def feature_profile(spark, sf_dir):
    rows = feat.feature_profile(_features(spark, sf_dir))
    return rows.withColumns({"mean": half_even(F.col("mean"), 4), "max": half_even(F.col("max"), 4)})


@query
def action_context(spark, sf_dir):
    tables = crm_tables(spark, sf_dir, ("customers", "engagement_events", "support_tickets", "agent_actions"))
    return feat.action_context(tables, tables["agent_actions"], AS_OF)


# ── scores ───────────────────────────────────────────────────────────────────


@query
def score_labels(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "customer_id", "churn_score", "conversion_score",
        sco.churn_label(F.col("churn_score")).alias("churn_risk"),
        sco.conversion_label(F.col("conversion_score")).alias("conversion_tier"),
    )


def _conversion(spark, sf_dir):
    """Fixture scores in the shape of the conversion model's output."""
    lower = _people(spark, sf_dir).filter("plan <> 'Enterprise'").select("customer_id", "plan")
    scored = lower.join(_scores(spark, sf_dir), "customer_id").select(
        "customer_id", "conversion_score",
        sco.conversion_label(F.col("conversion_score")).alias("conversion_tier"),
        F.col("plan").alias("current_plan"),
    )
    return sco.with_enterprise(scored, feat.customer_base(_people(spark, sf_dir), AS_OF))


@query
def conversion_tiers(spark, sf_dir):
    return _conversion(spark, sf_dir)


@query
def rfm_signals(spark, sf_dir):
    return sco.rfm(_features(spark, sf_dir))


@query
def cluster_profiles(spark, sf_dir):
    signals = sco.rfm(_features(spark, sf_dir))
    profiles = sco.profile_clusters(signals.withColumn("cluster", (_key("customer_id") % 5).cast("int")))
    rounded = {n: half_even(F.col(n), 4) for n in (*sco.RFM_COLUMNS, "score")}
    return profiles.withColumns(rounded)


@query
def segment_confidence(spark, sf_dir):
    """Distances of the signals, scaled by fixed ranges, to fixed centres."""
    ranges = {"recency": 100.0, "frequency": 200.0, "monetary": 10000.0, "engagement": 500.0, "health": 100.0, "tenure": 1000.0}
    point = [F.col(n) / span for n, span in ranges.items()]
    return sco.rfm(_features(spark, sf_dir)).select(
        "customer_id", sco.segment_confidence(point, CENTRES).alias("segment_confidence")
    )


@query
def lifetime_values(spark, sf_dir):
    rows = _people(spark, sf_dir).join(_scores(spark, sf_dir).select("customer_id", "churn_score"), "customer_id")
    return rows.select("customer_id", "mrr", "churn_score", sco.ltv_estimate(F.col("mrr"), F.col("churn_score")).alias("ltv"))


def _segments(spark, sf_dir):
    known = F.when(_key("customer_id") % 9 != 0, F.col("segment"))
    return _scores(spark, sf_dir).select("customer_id", known.alias("segment"))


@query
def assembled_predictions(spark, sf_dir):
    """Scores put together, with gaps on purpose: unknown conversions and segments take their defaults."""
    known = F.when(_key("customer_id") % 4 != 0, F.col("conversion_score"))
    conversion = _conversion(spark, sf_dir).withColumn("conversion_score", known)
    people = _people(spark, sf_dir)
    return sco.assemble_predictions(
        _scores(spark, sf_dir), conversion, _segments(spark, sf_dir), people, AS_OF
    ).drop("prediction_id")


@query
def inference_summary(spark, sf_dir):
    return sco.inference_summary(_scores(spark, sf_dir), _conversion(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    scored = _people(spark, sf_dir).join(_scores(spark, sf_dir), "customer_id")
    return sco.classification_report(scored, "is_churned", "churn_score")


@query
def classification_averages(spark, sf_dir):
    scored = _people(spark, sf_dir).join(_scores(spark, sf_dir), "customer_id")
    return sco.classification_averages(sco.classification_report(scored, "is_churned", "churn_score"))


@query
def confusion_matrix(spark, sf_dir):
    scored = _people(spark, sf_dir).join(_scores(spark, sf_dir), "customer_id")
    return sco.confusion_counts(scored, "is_churned", "churn_score")


# ── rules ────────────────────────────────────────────────────────────────────


@query
def enriched_customers(spark, sf_dir):
    """A quarter of the predictions is unknown, so that the defaults show."""
    known = _key("customer_id") % 4 != 0
    scores = _scores(spark, sf_dir)
    unknown = ("churn_score", "conversion_score", "segment", "ltv_estimate")
    scores = scores.withColumns({name: F.when(known, F.col(name)) for name in unknown})
    return rul.enrich(_features(spark, sf_dir), scores).select(
        "customer_id", "plan", "churn_score", "conversion_score", "segment", "ltv_estimate", "engagement_index"
    )


@query
def rule_candidates(spark, sf_dir):
    rows = rul.evaluate_rules(_enriched(spark, sf_dir))
    return rows.select(
        "customer_id", "action_type", "reason", "priority", "rule_id", "rule_order",
        _json("context", "$.suggested_plan").alias("suggested_plan"),
        _json("triggered_by", "$.churn_score", "double").alias("churn_signal"),
        _json("triggered_by", "$.conversion_score", "double").alias("conversion_signal"),
        _json("triggered_by", "$.segment").alias("segment_signal"),
        _json("triggered_by", "$.tenure_days", "bigint").alias("tenure_signal"),
        *[_json("triggered_by", f"$.{name}", kind).alias(f"{name}_signal") for name, kind in OTHER_SIGNALS.items()],
    )


@query
def rule_summary(spark, sf_dir):
    return rul.rule_summary(rul.evaluate_rules(_enriched(spark, sf_dir)))


@query
def priority_mismatches(spark, sf_dir):
    """Two rules that emit another priority than the registry states."""
    other = {"CHN-002": 3, "LYL-002": 2}
    changed = [replace(r, emits=other.get(r.rule_id)) for r in rul.REGISTRY]
    return rul.priority_mismatches(rul.evaluate_rules(_enriched(spark, sf_dir), changed), changed)


@query
def python_rule_candidates(spark, sf_dir):
    """The rule is a local function, so it travels to workers that do not have this package.

    Unknown values and results of a wrong type are among the rows.
    """

    def unhappy(row):
        if row["nps_score"] is None:
            return {"action_type": "send_health_checkin", "reason": "NPS unknown", "priority": "high"}
        if row["plan"] == "Pro" and row["nps_score"] < -50:
            if row["nps_score"] < -90:
                raise ValueError("nps out of range")
            shelf = sum(map(int, row["customer_id"][1:])) % 9
            return {"action_type": "send_health_checkin", "reason": f"NPS {row['nps_score']}, shelf {shelf}"}
        return None

    known = F.when(_key("customer_id") % 50 != 0, F.col("nps_score"))
    people = _people(spark, sf_dir).withColumn("nps_score", known)
    rows = rul.evaluate_python_rule(people, "PY-001", 2, unhappy, ["plan", "nps_score"])
    return rows.select("customer_id", "action_type", "reason", "priority", "rule_id", "error")


@query
def batch_rule_candidates(spark, sf_dir):
    """A rule over pandas batches that raises whenever one of three customers is in the batch."""
    missing = [f"C{n:07d}" for n in (11, 42, 97)]

    def promoters(part):
        if part["customer_id"].isin(missing).any():
            raise LookupError("no profile")
        hit = part[(part["plan"] != "Free") & (part["nps_score"] > 60)]
        return pd.DataFrame({"action_type": "send_loyalty_reward", "reason": "NPS " + hit["nps_score"].astype(str)}, index=hit.index)

    rows = rul.evaluate_batch_rule(_people(spark, sf_dir), "PB-001", 2, promoters, ["plan", "nps_score"])
    return rows.select("customer_id", "action_type", "reason", "priority", "rule_id", "error")


@query
def rule_candidates_apart(spark, sf_dir):
    """The registry and a rule that divides by the days since the last event, which are 0 for some."""
    busy = rul.Rule(
        "OWN-001", 2, "send_health_checkin",
        when=lambda: F.col("event_count_total") / F.col("days_since_last_event") > 0.5,
        reason=lambda: F.concat(F.col("event_count_total").cast("string"), F.lit(" events")),
        signals=("event_count_total", "days_since_last_event"),
    )
    rows = rul.evaluate_rules_apart(_enriched(spark, sf_dir), [*rul.REGISTRY, busy])
    return rows.select("customer_id", "action_type", "reason", "priority", "rule_id", "error")


# ── plans ────────────────────────────────────────────────────────────────────


@query
def fired_sets(spark, sf_dir):
    return _sets(spark, sf_dir).select(
        "customer_id", "rule_id", "priority", "n_candidates", "conflict", "churn_score", "ltv_estimate"
    )


@query
def fired_sets_from_candidates(spark, sf_dir):
    """The same from loose candidate rows."""
    enriched = _enriched(spark, sf_dir)
    return pln.group_candidates(rul.evaluate_rules(enriched), enriched).select(
        "customer_id", "rule_id", "priority", "n_candidates", "conflict", "churn_score", "ltv_estimate"
    )


def _plan_view(plans: DataFrame) -> DataFrame:
    return plans.select(
        "customer_id", "action_type", "reason", "priority", "rule_id", "llm_enhanced", "confidence",
        _json("metadata", "$.context.suggested_plan").alias("suggested_plan"),
        _json("metadata", "$.triggered_by.churn_score", "double").alias("churn_signal"),
        _json("metadata", "$.llm_notes").alias("notes"),
        _json("metadata", "$.candidates", "bigint").alias("candidates"),
    )


@query
def passthrough_plans(spark, sf_dir):
    return _plan_view(pln.passthrough_plan(_sets(spark, sf_dir)))


@query
def review_candidates(spark, sf_dir):
    return pln.review_candidates(_sets(spark, sf_dir), BUDGET).select(
        "customer_id", "n_candidates", "conflict", "churn_score", "ltv_estimate"
    )


@query
def decision_prompts(spark, sf_dir):
    fired = stored(rul.fire_rules(_enriched(spark, sf_dir)), "fired")
    return pln.decision_prompts(fired, pln.review_candidates(pln.fired_sets(fired), BUDGET))


@query
def parsed_decisions(spark, sf_dir):
    parsed = pln.parse_decisions(decision_responses(spark, sf_dir))
    return parsed.select(
        "customer_id",
        F.col("decision").isNotNull().alias("is_object"),
        F.try_variant_get("decision", "$.action_type", "string").alias("action_type"),
        F.try_variant_get("decision", "$.priority", "string").alias("priority"),
    )


@query
def validated_decisions(spark, sf_dir):
    return pln.validate_decisions(pln.parse_decisions(decision_responses(spark, sf_dir)))


@query
def resolved_plans(spark, sf_dir):
    return _plan_view(_resolved(spark, sf_dir))


@query
def plan_summary(spark, sf_dir):
    return pln.plan_summary(_resolved(spark, sf_dir))


# ── queue ────────────────────────────────────────────────────────────────────


@query
def cooldown_pairs(spark, sf_dir):
    return que.cooldown_pairs(_actions(spark, sf_dir), ACTIONS_AS_OF)


@query
def plans_after_cooldown(spark, sf_dir):
    plans = pln.passthrough_plan(_sets(spark, sf_dir))
    ready = que.drop_cooling(plans, que.cooldown_pairs(_actions(spark, sf_dir), ACTIONS_AS_OF))
    return ready.select("customer_id", "action_type", "priority", "rule_id")


@query
def plan_urgency(spark, sf_dir):
    plans = pln.passthrough_plan(_sets(spark, sf_dir)).drop("ltv_estimate")
    rows = que.attach_ltv(plans, _scores(spark, sf_dir))
    urgency = que.urgency_score(F.col("priority"), F.col("confidence"), F.col("ltv_estimate"))
    return rows.select("customer_id", "action_type", half_even(urgency, 6).alias("urgency_score"))


@query
def queued_actions(spark, sf_dir):
    return _cycle(spark, sf_dir).queue.select(
        "customer_id", "action_type", "priority", "status", "created_at",
        half_even(F.col("urgency_score"), 6).alias("urgency_score"), "action_id", "reason",
        _json("metadata", "$.context.suggested_plan").alias("suggested_plan"),
        _json("metadata", "$.triggered_by.churn_score", "double").alias("churn_signal"),
        _json("metadata", "$.llm_notes").alias("notes"),
        _json("metadata", "$.candidates", "bigint").alias("candidates"),
    )


@query
def queue_priorities(spark, sf_dir):
    return que.queue_priorities(_cycle(spark, sf_dir).queue)


@query
def pending_queue(spark, sf_dir):
    return que.pending_queue(_actions(spark, sf_dir), 100)


@query
def pending_page(spark, sf_dir):
    """A page that is cut by ranges instead of one task's top-k."""
    return que.pending_queue(_actions(spark, sf_dir), 2000, one_task_rows=100)


@query
def decision_cycle_summary(spark, sf_dir):
    return cycle_summary(_cycle(spark, sf_dir), AS_OF)


# ── outcomes and feedback ────────────────────────────────────────────────────


@query
def outcome_classes(spark, sf_dir):
    opened, clicked = out.email_flags(F.col("outcome"))
    return _actions(spark, sf_dir).filter("status = 'executed'").select(
        "action_id", "outcome", out.outcome_class(F.col("outcome")).alias("outcome_class"),
        opened.alias("opened"), clicked.alias("clicked"), fb.health_delta(F.col("outcome")).alias("delta"),
    )


@query
def rendered_messages(spark, sf_dir):
    """Messages of all actions; a tenth has an action type without a text of its own."""
    tables = crm_tables(spark, sf_dir)
    kind = F.when(_key("action_id") % 10 == 9, "call_partner").otherwise(F.col("action_type"))
    actions = tables["agent_actions"].withColumn("action_type", kind)
    context = feat.action_context(tables, actions, AS_OF)
    return render_messages(actions, tables["customers"], tables["ml_predictions"], context).select(
        "action_id", "customer_id", "action_type", "subject", "body", "channel", "cta", "discount_pct"
    )


@query
def discount_codes(spark, sf_dir):
    pct = F.when(F.col("mrr") >= 200, 20).otherwise(15)
    return _people(spark, sf_dir).select("customer_id", discount_code(pct, F.col("customer_id")).alias("code"))


@query
def suggested_plans(spark, sf_dir):
    plans = _people(spark, sf_dir).select("customer_id", "plan")
    rows = join_profiles(_actions(spark, sf_dir), plans, "customer_id", "action_id", hot_rows=50)
    return rows.select("action_id", suggested_plan(F.col("metadata"), F.col("plan")).alias("suggested_plan"))


@query
def execution_batch(spark, sf_dir):
    batch = out.execution_batch(crm_tables(spark, sf_dir), _given_outcomes(spark, sf_dir), AS_OF, 50)
    return batch.select(
        "action_id", "customer_id", "action_type", "status", "outcome", "outcome_class", "executed_at",
        "subject", "channel", "discount_pct",
    )


@query
def execution_report(spark, sf_dir):
    return out.execution_report(_actions(spark, sf_dir).filter("status = 'executed'"))


def _batch(spark, sf_dir):
    return fb.pending_feedback(_actions(spark, sf_dir), ACTIONS_AS_OF, FEEDBACK_HOURS)


@query
def pending_feedback(spark, sf_dir):
    return _batch(spark, sf_dir).select("action_id", "customer_id", "outcome", "executed_at")


@query
def updated_health(spark, sf_dir):
    """All unapplied outcomes of a month, folded in order."""
    batch = fb.pending_feedback(_actions(spark, sf_dir), ACTIONS_AS_OF, 24 * 31)
    return fb.apply_health(_people(spark, sf_dir), batch).select(
        "customer_id", half_even(F.col("health_score"), 6).alias("health_score")
    )


@query
def marked_actions(spark, sf_dir):
    return fb.mark_applied(_actions(spark, sf_dir), _batch(spark, sf_dir), ACTIONS_AS_OF).select(
        "action_id", "status", "feedback_applied_at"
    )


@query
def feedback_after_marking(spark, sf_dir):
    """What is left to apply once half of the batch is marked, by outcome."""
    half = _batch(spark, sf_dir).filter(_key("action_id") % 2 == 0)
    marked = fb.mark_applied(_actions(spark, sf_dir), half, ACTIONS_AS_OF)
    left = fb.pending_feedback(marked, ACTIONS_AS_OF, FEEDBACK_HOURS)
    return left.groupBy("outcome").agg(F.count(F.lit(1)).alias("left_over"), F.min("action_id").alias("first_left"))


def _feedback_run(spark, sf_dir, log: str, staging: str):
    tables = crm_tables(spark, sf_dir, ("customers", "agent_actions"))
    return run_feedback(
        spark, tables["customers"], tables["agent_actions"], ACTIONS_AS_OF, log, staging, FEEDBACK_HOURS
    )


@query
def feedback_logged(spark, sf_dir):
    """Applied actions are kept in a log of their own; a second run finds nothing to apply."""
    log = scratch_path(spark, "applied")
    for _ in range(2):
        _feedback_run(spark, sf_dir, log, scratch_path(spark, "staging"))
    return sinks.read_feedback_log(spark, log)


@query
def feedback_run_health(spark, sf_dir):
    """Customers after a feedback run of which the first attempt is repeated."""
    log, staging = scratch_path(spark, "applied"), scratch_path(spark, "staging")
    _feedback_run(spark, sf_dir, log, staging)
    people = _feedback_run(spark, sf_dir, log, staging).customers
    return people.select("customer_id", half_even(F.col("health_score"), 6).alias("health_score"))


@query
def execution_run(spark, sf_dir):
    """A page of the stored queue executed and committed, with the attempt repeated."""
    actions, mails, staging = (scratch_path(spark, n) for n in ("actions", "mails", "staging"))
    tables = crm_tables(spark, sf_dir)
    sinks.write_actions(tables["agent_actions"], actions)
    for _ in range(2):
        run_execution(spark, tables, _given_outcomes(spark, sf_dir), AS_OF, actions, mails, staging, 2000)
    logged = spark.read.parquet(mails).select(F.col("email_id").substr(5, 64).alias("action_id"), "opened", "clicked")
    return sinks.read_actions(spark, actions).select("action_id", "status", "outcome").join(logged, "action_id", "left")


@query
def feedback_summary(spark, sf_dir):
    return fb.feedback_summary(_batch(spark, sf_dir))


@query
def feedback_signals(spark, sf_dir):
    return fb.feedback_signals(_batch(spark, sf_dir))


# ── reports ──────────────────────────────────────────────────────────────────


def _kpis(spark, sf_dir):
    tables = crm_tables(spark, sf_dir, ("customers", "ml_predictions", "agent_actions"))
    return rep.kpi_summary(*tables.values())


@query
def kpi_summary(spark, sf_dir):
    return _kpis(spark, sf_dir)


@query
def kpi_texts(spark, sf_dir):
    row = _kpis(spark, sf_dir)
    return row.select(short_money(F.col("total_mrr")).alias("mrr"), short_money(F.col("total_ltv")).alias("ltv"))


@query
def segment_counts(spark, sf_dir):
    return rep.segment_counts(_scores(spark, sf_dir))


@query
def customer_list(spark, sf_dir):
    return rep.list_customers(*_people_and_scores(spark, sf_dir))


@query
def customer_list_filtered(spark, sf_dir):
    return rep.list_customers(
        *_people_and_scores(spark, sf_dir), plan="Starter", segment="Loyal",
        min_churn=0.2, max_churn=0.9, limit=20, offset=5,
    )


@query
def risk_profiles(spark, sf_dir):
    return rep.risk_profiles(*_people_and_scores(spark, sf_dir))


@query
def customer_risk(spark, sf_dir):
    return rep.customer_risk(*_people_and_scores(spark, sf_dir), ONE_CUSTOMER)


@query
def customer_actions(spark, sf_dir):
    return rep.customer_actions(_actions(spark, sf_dir), "C0000010")


@query
def churn_ranking(spark, sf_dir):
    return rep.churn_ranking(*_people_and_scores(spark, sf_dir), 0.1, 50, labels=True)


@query
def conversion_ranking(spark, sf_dir):
    return rep.conversion_ranking(*_people_and_scores(spark, sf_dir))


@query
def segment_metrics(spark, sf_dir):
    return rep.segment_metrics(*_people_and_scores(spark, sf_dir))


@query
def action_queue(spark, sf_dir):
    return que.action_queue(_actions(spark, sf_dir), "executed", 5, 50)


@query
def action_by_id(spark, sf_dir):
    return rep.action_by_id(_actions(spark, sf_dir), ONE_ACTION)


@query
def latest_executed(spark, sf_dir):
    return rep.latest_executed(_actions(spark, sf_dir))


@query
def data_summary(spark, sf_dir):
    return rep.data_summary(crm_tables(spark, sf_dir, FEATURE_TABLES))


@query
def churn_band_distribution(spark, sf_dir):
    return rep.churn_band_distribution(_scores(spark, sf_dir))


@query
def outcome_distribution(spark, sf_dir):
    return rep.outcome_distribution(_actions(spark, sf_dir))


# ── models ───────────────────────────────────────────────────────────────────

_STORED: dict[tuple[str, str], DataFrame] = {}


def _stored(spark, sf_dir) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = stored_features(crm_tables(spark, sf_dir, FEATURE_TABLES), AS_OF)
    return _STORED[key]


_TRAINERS = {
    "churn": (trn.Trained, trn.train_churn),
    "conversion": (trn.Trained, trn.train_conversion),
    "segments": (seg.SegmentModel, seg.train_segments),
}


def _model(spark, sf_dir, task: str):
    """Trained once per application and folder, then read from where it was saved."""
    place = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()
    path = f"{shared_dir(spark)}/models-{spark.sparkContext.applicationId}/{place}-{task}"
    kind, train = _TRAINERS[task]
    return load_or_train(kind, path, lambda: train(_stored(spark, sf_dir)))


# What a model answers depends on its library; what must hold for any answer is exact, and that is registered.


def _report_checks(report: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: customers of either class, whether a fifth of each is held out and judged, families compared, figures in range."""

    def of(prefix, how):
        return how(F.when(F.col("metric").startswith(prefix), F.col("value")))

    share = F.col("value").between(0.0, 1.0)
    figures = F.col("metric").rlike("^(cv_auc|test_auc|precision|recall|f1|importance)")
    checks = report.agg(
        of("support_0", F.max).alias("held_0"), of("support_1", F.max).alias("held_1"), of("confusion_", F.sum).alias("judged"),
        of("cv_auc_", F.count).alias("families"), of("chosen_", F.count).alias("chosen"),
        F.min(F.when(figures, share)).alias("figures_in_range"),
    )
    counts = labelled.agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("customers_0"), F.count(F.when(F.col("label") == 1, 1)).alias("customers_1")
    )
    # The quantiles that cut the parts are approximate.
    fifth = [F.abs(F.col(f"held_{k}") - 0.2 * F.col(f"customers_{k}")) <= 1 + 0.001 * F.col(f"customers_{k}") for k in (0, 1)]
    return sco.one_row(checks, counts).select(
        "customers_0", "customers_1", "families", "chosen", "figures_in_range",
        (fifth[0] & fifth[1]).alias("a_fifth_is_held_out"), (F.col("judged") == F.col("held_0") + F.col("held_1")).alias("all_are_judged"),
    )


@query
def churn_model_report(spark, sf_dir):
    labelled = _stored(spark, sf_dir).select(F.col("is_churned").alias("label"))
    return _report_checks(trn.model_report(spark, _model(spark, sf_dir, "churn")), labelled)


@query
def churn_scores(spark, sf_dir):
    """Every customer has a score in range, and a label that fits it (at a border, either one does)."""
    scored = trn.predict_churn(_model(spark, sf_dir, "churn"), _stored(spark, sf_dir))
    return scored.select("customer_id", *_score_checks("churn_score", "churn_risk", sco.churn_label))


def _score_checks(score: str, label: str, of):
    value = F.col(score)
    fits = [F.col(label).eqNullSafe(of(value + shift)) for shift in (-1e-4, 0.0, 1e-4)]
    return value.between(0.0, 1.0).alias("in_range"), (fits[0] | fits[1] | fits[2]).alias("label_fits")


@query
def conversion_model_report(spark, sf_dir):
    labelled = _stored(spark, sf_dir).filter("plan_rank < 3").select((F.col("plan_rank") >= 2).cast("int").alias("label"))
    return _report_checks(trn.model_report(spark, _model(spark, sf_dir, "conversion")), labelled)


@query
def conversion_scores(spark, sf_dir):
    scored = trn.predict_conversion(_model(spark, sf_dir, "conversion"), _stored(spark, sf_dir))
    return scored.select(
        "customer_id", "current_plan", *_score_checks("conversion_score", "conversion_tier", sco.conversion_label),
        ((F.col("current_plan") != "Enterprise") | (F.col("conversion_score") == 1.0)).alias("enterprise_is_one"),
    )


@query
def segment_model_report(spark, sf_dir):
    """Five clusters of different names hold all customers."""
    report = seg.segment_report(_model(spark, sf_dir, "segments"), _stored(spark, sf_dir))
    return report.agg(
        F.sum("customers").alias("customers"), F.count_distinct("cluster").alias("clusters"),
        F.count_distinct("segment").alias("names"), F.sort_array(F.collect_list("rank")).cast("string").alias("ranks"),
        F.min(F.col("silhouette").between(-1.0, 1.0)).alias("silhouette_in_range"),
    )


@query
def segment_scores(spark, sf_dir):
    """Every customer has a cluster, the name of that cluster and a confidence."""
    model = _model(spark, sf_dir, "segments")
    scored = seg.predict_segments(model, _stored(spark, sf_dir))
    named = [F.col("cluster_id").eqNullSafe(F.lit(c)) & (F.col("segment") == name) for c, name in model.names.items()]
    return scored.select(
        "customer_id", reduce(lambda a, b: a | b, named).alias("named_as_its_cluster"),
        F.col("segment_confidence").between(0.0, 1.0).alias("confidence_in_range"),
    )


@query
def model_predictions(spark, sf_dir):
    """One prediction per customer; the lifetime value follows from its own churn score."""
    models = Models(*(_model(spark, sf_dir, task) for task in _TRAINERS))
    people = _people(spark, sf_dir).select("customer_id", "plan", "mrr")
    rows = run_inference(models, _stored(spark, sf_dir), AS_OF).join(people, "customer_id")
    value = half_even(F.col("mrr") * (1.0 - F.col("churn_score")) * 24.0, 2)
    return rows.select(
        "customer_id", "predicted_at",
        (F.col("churn_score").between(0.0, 1.0) & F.col("conversion_score").between(0.0, 1.0)).alias("in_range"),
        ((F.col("plan") != "Enterprise") | (F.col("conversion_score") == 1.0)).alias("enterprise_is_one"),
        F.col("segment").isin("Champion", "Loyal", "At-Risk", "Prospect", "Lost").alias("segment_known"),
        (F.col("ltv_estimate") == value).alias("value_follows"),
    )


# ── streams ──────────────────────────────────────────────────────────────────


@query
def streamed_health(spark, sf_dir):
    """The month's outcomes arrive in three parts, the latest days first, the last part with copies of the first."""
    source, state = scratch_path(spark, "outcomes"), scratch_path(spark, "health")
    executed = _actions(spark, sf_dir).filter("status = 'executed' AND feedback_applied_at IS NULL").select(
        "action_id", "customer_id", "outcome", "executed_at"
    )
    day = F.dayofmonth("executed_at")
    arrivals = [day > 20, (day > 10) & (day <= 20), (day <= 10) | (day > 27)]
    for arrival in arrivals:
        executed.filter(arrival).write.mode("append").parquet(source)
        stream = spark.readStream.schema(executed.schema).parquet(source)
        start_feedback(stream, state).awaitTermination()
    return current_health(spark, _people(spark, sf_dir), state).select(
        "customer_id", half_even(F.col("health_score"), 6).alias("health_score")
    )


@query
def streamed_event_counts(spark, sf_dir):
    source, state = scratch_path(spark, "events"), scratch_path(spark, "daily")
    events = crm_table(spark, sf_dir, "engagement_events").select("event_id", "customer_id", "event_date")
    # A third of the events is delivered a second time.
    for part in (events, events.filter(_key("event_id") % 3 == 0)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        start_engagement(stream, state).awaitTermination()
    return rolling_counts(daily_counts(spark, state), AS_OF)


def _arrivals(spark, rows, row_id, time, end, days, first, very_late):
    """Writes ``rows`` part by part, ``days`` days each, and returns the folder after each of them.

    A tenth arrives one part late, a seventh once more in the part after its own, under the next day. Of those whose key leaves 3 by 17 and
    that are ``very_late`` all arrive four parts late. The last part moves the watermark past everything.
    """
    source = scratch_path(spark, "arrivals")
    key = _key(row_id)
    own = F.floor(F.datediff(time, F.lit(first)) / days) + F.when(key % 10 == 0, 1).otherwise(0)
    own = own + (F.when(key % 17 == 3, 4).otherwise(0) if very_late else F.lit(0))
    numbered = rows.withColumn("part", own)
    again = numbered.filter(key % 7 == 0).withColumns({"part": F.col("part") + 1, time: F.col(time) + F.expr("INTERVAL 1 DAY")})
    every = stored(numbered.unionByName(again), "numbered")
    for part in sorted(r["part"] for r in every.select("part").distinct().collect()):
        every.filter(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        yield source
    last = {row_id: F.lit("end"), "customer_id": F.lit("-"), time: F.lit(end).cast("timestamp_ntz")}
    spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]).write.mode("append").parquet(source)
    yield source


@query
def streamed_rolling_counts(spark, sf_dir):
    """Sliding windows of 30 days over event time; rows are late, too late, out of order and repeated under another day."""
    events = crm_table(spark, sf_dir, "engagement_events").select("event_id", "customer_id", "event_date").filter("customer_id IS NOT NULL")
    state = scratch_path(spark, "rolling")
    for source in _arrivals(spark, events, "event_id", "event_date", "2025-01-01", 12, "2024-01-01", very_late=True):
        stream = spark.readStream.schema(events.schema).parquet(source)
        append_to(rolling_event_counts(stream, delay="26 days"), state).awaitTermination()
    return appended(spark, state).filter("customer_id <> '-'")


@query
def streamed_health_in_order(spark, sf_dir):
    """Outcomes that arrive late, out of order and again under another day, in a stream that is started anew for each part."""
    executed = _actions(spark, sf_dir).filter("status = 'executed' AND feedback_applied_at IS NULL").select(
        "action_id", "customer_id", "outcome", "executed_at"
    )
    state = scratch_path(spark, "ordered")
    for source in _arrivals(spark, executed, "action_id", "executed_at", "2025-01-01", 10, "2024-01-01", very_late=False):
        stream = spark.readStream.schema(executed.schema).parquet(source)
        append_to(ordered_steps(stream, delay="30 days"), state).awaitTermination()
    return ordered_health(spark, _people(spark, sf_dir), state).select(
        "customer_id", half_even(F.col("health_score"), 6).alias("health_score")
    )
