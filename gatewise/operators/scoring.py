"""Rule scores over feature rows: a map-only pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gatewise.functions import risk
from gatewise.functions.risk import RiskParams


def score_events(features: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Adds score, level, colour, decision and reasons (an array of sentences)."""
    c = F.col
    scored = features.withColumn("score", risk.total_score(params))
    levelled = scored.withColumn("level", risk.level(c("score"), params))
    return levelled.select(
        "*",
        risk.colour(c("level")).alias("colour"),
        risk.decision(c("level"), params).alias("decision"),
        risk.reasons(params).alias("reasons"),
    )


MODEL_REASON = "the model finds this login suspicious"


def combine(scored: DataFrame, points: int = 60, said_from: float = 0.5, params: RiskParams = RiskParams()) -> DataFrame:
    """Rule scores and a model's ``model_score`` as one score that decides.

    The model adds up to ``points``, in proportion to its probability and rounded down; level, colour and decision follow
    the sum ``combined_score``. Rules stay in ``score``; the model is among the reasons from a probability of ``said_from`` on.
    """
    c = F.col
    total = scored.withColumn("combined_score", c("score") + F.floor(c("model_score") * points).cast("int"))
    levelled = total.withColumn("level", risk.level(c("combined_score"), params))
    return levelled.withColumns({
        "colour": risk.colour(c("level")),
        "decision": risk.decision(c("level"), params),
        "reasons": F.when(c("model_score") >= said_from, F.array_append("reasons", F.lit(MODEL_REASON))).otherwise(c("reasons")),
    })


def gold_label():
    """A successful login from a listed address."""
    return F.coalesce(F.col("is_attack_ip") & F.col("login_success"), F.lit(False))


def with_gold(events: DataFrame) -> DataFrame:
    return events.withColumn("is_gold", gold_label())


def level_counts(scored: DataFrame) -> DataFrame:
    """Rows per level and decision."""
    return scored.groupBy("level", "decision").agg(
        F.count(F.lit(1)).alias("events"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )


def rule_firing(features: DataFrame, label: str = "is_gold", params: RiskParams = RiskParams()) -> DataFrame:
    """Per rule and label value: how often it fires and at what rate.

    All rules are counted in one aggregation by label (two groups, combined map-side)
    and turned into rows afterwards.
    """
    hits = risk.rule_hits(params)
    names = [rule for rule, _, _ in risk.RULES]
    wide = features.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("events"), *[F.count_if(hits[n]).alias(n) for n in names]
    )
    long = wide.unpivot(["label", "events"], names, "rule", "fired")
    points = F.create_map(*[F.lit(x) for rule, pts, _ in risk.RULES for x in (rule, pts)])
    return long.select(
        "rule", "label", "events", "fired",
        (F.col("fired").cast("double") / F.col("events")).alias("rate"),
        F.element_at(points, F.col("rule")).alias("points"),
    )
