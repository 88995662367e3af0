"""Labels, bands, RFM signals, lifetime value and the assembled prediction rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clientele.functions import as_timestamp, half_even
from clientele.schemas import SEGMENTS

RFM_COLUMNS = ("recency", "frequency", "monetary", "engagement", "health", "tenure")

# Share of each signal in the score that ranks the clusters.
CLUSTER_WEIGHTS = {
    "recency": 0.25, "monetary": 0.30, "frequency": 0.20, "engagement": 0.15, "health": 0.10,
}
LTV_MONTHS = 24


def _binned(score: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open bin (low, high] that holds the score; outside all bins null."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(cuts[:-1], cuts[1:], labels))):
        label = F.when((score > low) & (score <= high), F.lit(name)).otherwise(label)
    return label


def churn_label(score: Column) -> Column:
    """Risk label of a model score before rounding; exactly 0 has none."""
    return _binned(score, (0.0, 0.3, 0.6, 1.0), ("Low", "Medium", "High"))


def conversion_label(score: Column) -> Column:
    """Tier of a model score before rounding; exactly 0 has none."""
    return _binned(score, (0.0, 0.35, 0.65, 1.0), ("Cold", "Warm", "Hot"))


def risk_band(score: Column) -> Column:
    """Risk band of the reports: closed below, unlike :func:`churn_label`."""
    return F.when(score >= 0.6, "High").when(score >= 0.3, "Medium").otherwise("Low")


def conversion_band(score: Column) -> Column:
    return F.when(score >= 0.7, "Hot").when(score >= 0.4, "Warm").otherwise("Cold")


def rfm(features: DataFrame) -> DataFrame:
    """Recency, frequency and monetary signals with engagement, health and tenure."""
    double = {
        "recency": 100 - F.least(F.col("days_since_last_event"), F.lit(100)),
        "frequency": F.col("event_count_total") + F.col("txn_count"),
        "monetary": F.col("mrr") + F.greatest(F.col("total_spend"), F.lit(0.0)),
        "engagement": F.col("engagement_index"),
        "health": F.col("health_score"),
        "tenure": F.col("tenure_days"),
    }
    return features.select(
        "customer_id", *[double[name].cast("double").alias(name) for name in RFM_COLUMNS]
    )


def ltv_estimate(mrr: Column, churn_score: Column) -> Column:
    """Two years of revenue weighted by the (already rounded) chance to stay."""
    return half_even(mrr * (1.0 - churn_score) * float(LTV_MONTHS), 2)


def with_enterprise(scored: DataFrame, features: DataFrame) -> DataFrame:
    """Conversion scores of the lower plans plus the constant row of each Enterprise customer."""
    top = features.filter("plan_rank = 3").select(
        "customer_id",
        F.lit(1.0).alias("conversion_score"),
        F.lit("Hot").alias("conversion_tier"),
        F.col("plan").alias("current_plan"),
    )
    return scored.unionByName(top)


def profile_clusters(clustered: DataFrame) -> DataFrame:
    """Mean signals of each cluster, its weighted score, rank and segment name.

    ``clustered`` is :func:`rfm` output with a ``cluster`` column. The window ranks
    the clusters, of which there are as many as segment names.
    """
    means = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        *[half_even(F.avg(name), 6).alias(name) for name in RFM_COLUMNS],
    )
    score = sum((F.col(name) * weight for name, weight in CLUSTER_WEIGHTS.items()), F.lit(0.0))
    order = W.orderBy(F.col("score").desc(), F.col("cluster").asc())
    ranked = means.withColumn("score", half_even(score, 6)).withColumn("rank", F.row_number().over(order))
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    return ranked.withColumn("segment", F.try_element_at(names, F.col("rank")))


def segment_confidence(signals: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """1 − nearest / farthest distance to the cluster centres, 3 decimals."""
    distances = [
        F.sqrt(sum(((x - float(c)) * (x - float(c)) for x, c in zip(signals, centre)), F.lit(0.0)))
        for centre in centres
    ]
    return half_even(1.0 - F.least(*distances) / (F.greatest(*distances) + 1e-9), 3)


def assemble_predictions(
    churn: DataFrame, conversion: DataFrame, segments: DataFrame, customers: DataFrame, as_of
) -> DataFrame:
    """One prediction row per scored customer; a rerun at the same time gives the same ids."""
    now = as_timestamp(as_of)
    joined = (
        churn.select("customer_id", "churn_score")
        .join(conversion.select("customer_id", "conversion_score"), "customer_id", "left")
        .join(segments.select("customer_id", "segment"), "customer_id", "left")
        .join(customers.select("customer_id", "mrr"), "customer_id", "left")
    )
    return joined.select(
        F.sha2(F.concat_ws("|", F.lit("prediction"), "customer_id", now.cast("string")), 256).alias("prediction_id"),
        "customer_id",
        "churn_score",
        F.coalesce("conversion_score", F.lit(0.5)).alias("conversion_score"),
        F.coalesce("segment", F.lit("Unknown")).alias("segment"),
        ltv_estimate(F.col("mrr"), F.col("churn_score")).alias("ltv_estimate"),
        now.alias("predicted_at"),
    )


def inference_summary(predictions: DataFrame, conversion: DataFrame) -> DataFrame:
    """Volumes of one scoring run, also by segment; high risk here means strictly above 0.6."""
    scored = predictions.agg(
        F.count(F.lit(1)).alias("customers_scored"),
        half_even(F.avg("churn_score"), 3).alias("avg_churn_score"),
        F.count(F.when(F.col("churn_score") > 0.6, 1)).alias("high_risk"),
        half_even(F.sum("ltv_estimate"), 2).alias("total_ltv"),
        *[
            F.count(F.when(F.col("segment") == name, 1)).alias(f"in_{name.lower().replace('-', '_')}")
            for name in (*SEGMENTS, "Unknown")
        ],
    )
    hot = conversion.agg(F.count(F.when(F.col("conversion_tier") == "Hot", 1)).alias("hot_conversions"))
    return one_row(scored, hot)


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def confusion_counts(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Customers per true label and predicted label."""
    return scored.select(
        F.col(label).cast("int").alias("label"),
        (F.col(score) >= threshold).cast("int").alias("predicted"),
    ).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("customers"))


def classification_averages(report: DataFrame) -> DataFrame:
    """Accuracy, and the plain and the support-weighted mean of the classes of a :func:`classification_report`."""
    total = F.sum("support")
    means = {"macro": lambda name: F.avg(name), "weighted": lambda name: F.sum(F.col(name) * F.col("support")) / total}
    figures = ("precision", "recall", "f1")
    sums = report.agg(*[half_even(mean(name), 6).alias(f"{kind}_{name}") for kind, mean in means.items() for name in figures])
    # The support-weighted recall is the share of right answers.
    rows = [F.struct(F.lit("accuracy").alias("average"), *[F.col("weighted_recall").alias(name) for name in figures])]
    rows += [F.struct(F.lit(kind).alias("average"), *[F.col(f"{kind}_{name}").alias(name) for name in figures]) for kind in means]
    return sums.select(F.inline(F.array(*rows)))


def classification_report(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each class at a threshold, from one pass."""
    counts = confusion_counts(scored, label, score, threshold)
    sides = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("class"),
                        F.when((F.col("label") == k) & (F.col("predicted") == k), F.col("customers")).otherwise(0).alias("hit"),
                        F.when(F.col("predicted") == k, F.col("customers")).otherwise(0).alias("called"),
                        F.when(F.col("label") == k, F.col("customers")).otherwise(0).alias("actual"),
                    )
                    for k in (0, 1)
                ]
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("called").alias("called"), F.sum("actual").alias("support")
    )
    precision = F.col("hit") / F.greatest(F.col("called"), F.lit(1))
    recall = F.col("hit") / F.greatest(F.col("support"), F.lit(1))
    f1 = F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("called") + F.col("support"))).otherwise(0.0)
    return sums.select(
        "class",
        half_even(precision, 6).alias("precision"),
        half_even(recall, 6).alias("recall"),
        half_even(f1, 6).alias("f1"),
        "support",
    )
