"""Retrieval scores, the regression gate, costs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lexspark.sources import schemas

REPORTED_K = (3, 5, 10)
# Fixed values of the gate.
TOLERANCE, EPSILON = 0.03, 1e-9


def per_question(truth: DataFrame, retrieved: DataFrame, ks: Sequence[int] = REPORTED_K) -> DataFrame:
    """One row a question of `truth` (qid, act, article): n_truth, first (rank of the first right one),
    found (all found, at any rank) and recall_k, hit_k for each k, from `retrieved` (qid, act,
    article, rank). Questions that retrieve nothing right count with 0."""
    told = truth.select("qid", "act", "article").distinct()
    met = told.join(retrieved.select("qid", "act", "article", "rank"), ["qid", "act", "article"], "left")
    within = {k: F.count_if(F.col("rank") <= k) for k in ks}
    n = F.count_distinct(F.struct("act", "article"))
    return met.groupBy("qid").agg(
        n.alias("n_truth"),
        F.min("rank").alias("first"),
        (F.count("rank") / F.count("*")).alias("pool"),
        *[(within[k] / F.count("*")).alias(f"recall_{k}") for k in ks],
        *[F.when(within[k] > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks],
    )


def scores(rows: DataFrame, ks: Sequence[int] = REPORTED_K, digits: int = 6) -> DataFrame:
    """Macro means over questions: recall@k, hit rate@k, MRR, pool recall, headroom over recall@5."""
    means = [F.round(F.avg(f"recall_{k}"), digits).alias(f"recall_at_{k}") for k in ks]
    means += [F.round(F.avg(f"hit_{k}"), digits).alias(f"hit_rate_{k}") for k in ks]
    mrr = F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))
    return rows.agg(
        F.count("*").alias("n_questions"),
        *means,
        F.round(mrr, digits).alias("mrr"),
        F.round(F.avg("pool"), digits).alias("pool_recall"),
    )


def missed(rows: DataFrame, k: int = 5) -> DataFrame:
    """Questions with no right article among the first k."""
    return rows.where(F.col(f"hit_{k}") == 0).select("qid")


def history_row(spark, scored: Row, missed_at_5: Sequence[str], context: Mapping) -> DataFrame:
    """One run as a history row (context, metrics): `scored` is a row of `scores`, `context` the run's
    provenance (commit, time, models, configuration and manifest digests, cost, duration)."""
    metrics = dict.fromkeys(schemas.struct(schemas.METRICS).names) | {
        "layer": "retrieval",
        "n_questions": scored.n_questions,
        "recall_at_k": {n.rpartition("_")[2]: v for n, v in scored.asDict().items() if n.startswith("recall_at_")},
        "mrr": scored.mrr,
        "misses_at_5": list(missed_at_5),
    }
    return spark.createDataFrame([{"context": dict(context), "metrics": metrics}], schemas.history(with_seq=False))


def tracked(history: DataFrame) -> DataFrame:
    """(run_seq, layer, metric, value) of history rows with `recall_at_k` and plain metrics in a map."""
    return history.select("run_seq", "layer", F.explode("metrics").alias("metric", "value"))


def gate(values: DataFrame, floors: Mapping[str, float] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The last run of each layer against the one before: (layer, metric, value, previous, delta,
    regressed, below_floor, passed). `values` has run_seq, layer, metric, value. A fall of exactly the
    tolerance passes; a metric that the run before lacks is new and compares with nothing; floors hold
    for first runs too. Layers do not mix."""
    runs = values.select("layer", "run_seq").distinct()
    place = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("run_seq")))
    runs = runs.withColumn("back", place).where("back <= 2")
    last = values.join(runs.where("back = 1").drop("back"), ["layer", "run_seq"])
    before = values.join(runs.where("back = 2").drop("back"), ["layer", "run_seq"])
    before = before.select("layer", "metric", F.col("value").alias("previous"))
    out = last.join(before, ["layer", "metric"], "left").withColumn("delta", F.col("value") - F.col("previous"))
    limits = F.create_map(*[F.lit(x) for p in floors.items() for x in p]) if floors else None
    floor = limits[F.col("metric")] if floors else F.lit(None).cast("double")
    regressed = F.coalesce(F.col("delta") < -tolerance - EPSILON, F.lit(False))
    below = F.coalesce(F.col("value") < floor, F.lit(False))
    return out.select("layer", "metric", "value", "previous", "delta", regressed.alias("regressed"), below.alias("below_floor"), (~regressed & ~below).alias("passed"))


def latest_for_layer(history: DataFrame) -> DataFrame:
    """The row with the highest run_seq of each layer."""
    row = F.struct(*[c for c in history.columns if c != "layer"])
    return history.groupBy("layer").agg(F.max_by(row, F.col("run_seq")).alias("r")).select("layer", "r.*")


def usage(calls: DataFrame, prices: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Tokens and cost by model (`by` has it, and may have more) of `calls` (model, input_tokens, output_tokens) at `prices` (model,
    rate_in, rate_out, a million tokens). An unpriced model is charged the highest rates known."""
    top = prices.agg(F.max(F.struct("rate_in", "rate_out")).alias("top"))
    sums = calls.groupBy(*by).agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )
    priced = sums.join(prices, "model", "left").crossJoin(F.broadcast(top))
    known = F.col("rate_in").isNotNull()
    rate_in, rate_out = F.when(known, F.col("rate_in")).otherwise(F.col("top.rate_in")), F.when(known, F.col("rate_out")).otherwise(F.col("top.rate_out"))
    cost = (F.col("input_tokens") * rate_in + F.col("output_tokens") * rate_out) / 1_000_000
    return priced.select(*by, "calls", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost_usd"))


def estimate(prompts: DataFrame, rate_in: float, rate_out: float, output_tokens: int, ratio: float = 1.0, ceiling: float = 5.0) -> DataFrame:
    """Cost of `prompts` (text) before they are sent, scaled from a sample by `ratio`, and whether it
    stays below the ceiling."""
    from lexspark.functions.text import token_estimate

    sums = prompts.agg(F.sum(token_estimate(F.col("text"))).alias("input_tokens"), F.count("*").alias("calls"))
    cost = (F.col("input_tokens") * rate_in + F.col("calls") * output_tokens * rate_out) * ratio / 1_000_000
    return sums.select("calls", "input_tokens", F.round(cost, 6).alias("cost_usd"), (cost <= ceiling).alias("within"))


def config_hash(settings: Mapping) -> str:
    """First 12 hex digits of the digest of settings as compact, key-sorted JSON."""
    return hashlib.sha256(json.dumps(dict(settings), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def audit_scores(found: DataFrame) -> DataFrame:
    """Precision, recall and F1 by violation type of `found` (kind, planted, flagged)."""
    sums = found.groupBy("kind").agg(
        F.count_if(F.col("planted") & F.col("flagged")).alias("tp"),
        F.count_if(~F.col("planted") & F.col("flagged")).alias("fp"),
        F.count_if(F.col("planted") & ~F.col("flagged")).alias("fn"),
    )
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select("kind", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
