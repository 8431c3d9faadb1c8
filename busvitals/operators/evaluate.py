"""Detection quality. Inputs carry ``attack_label``, ``attack_type``, a score (low = anomalous) and ``is_anomaly``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators.ordering import attach, running_totals
from busvitals.operators.sampling import sample_rows


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_matrix(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit, attack = F.col("is_anomaly") == 1, F.col("attack_label") == 1
    return classified.groupBy(*by).agg(
        F.count_if(~attack & ~hit).alias("tn"),
        F.count_if(~attack & hit).alias("fp"),
        F.count_if(attack & ~hit).alias("fn"),
        F.count_if(attack & hit).alias("tp"),
    )


def classification_metrics(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion_matrix(classified, by).select(
        *by,
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(fp, fp + tn).alias("fpr"),
        _ratio(tp, tp + fn).alias("detection_rate"),
    )


def _by_score(scored: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """Attack and normal counts per distinct score with their running totals from the most anomalous on."""
    counts = scored.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(F.col("attack_label") == 1).alias("_pos"), F.count_if(F.col("attack_label") == 0).alias("_neg")
    )
    return running_totals(counts, by, ["_s"], {"_cpos": "_pos", "_cneg": "_neg"})


def _totals(scored: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    return scored.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count_if(F.col("attack_label") == 1).alias("_npos"), F.count_if(F.col("attack_label") == 0).alias("_nneg")
    )


def _join_totals(ranked: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    return ranked.join(F.broadcast(totals), list(by)) if by else attach(ranked, totals)


def roc_auc(scored: DataFrame, score: str = "anomaly_score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the curve of -score (ties count half); 0 with one class only."""
    ranked = _by_score(scored, score, by)
    # a pair is won when the attack has the smaller score: normals not yet passed, half of those tied
    wins = ranked.groupBy(*by).agg(
        F.sum(F.col("_neg") * ((F.col("_cpos") - F.col("_pos")) + F.col("_pos") * F.lit(0.5))).alias("_wins")
    )
    totals = _totals(scored, score, by)
    return _join_totals(wins, totals, by).select(*by, _ratio(F.col("_wins"), F.col("_npos") * F.col("_nneg")).alias("auc"))


def average_precision(scored: DataFrame, score: str = "anomaly_score", by: Sequence[str] = ()) -> DataFrame:
    ranked = _join_totals(_by_score(scored, score, by), _totals(scored, score, by), by)
    gain = _ratio(F.col("_pos"), F.col("_npos")) * _ratio(F.col("_cpos"), F.col("_cpos") + F.col("_cneg"))
    return ranked.groupBy(*by).agg(F.sum(gain).alias("avg_precision"))


def roc_curve(scored: DataFrame, score: str = "anomaly_score", by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every distinct score, flagging scores up to and including it."""
    ranked = _join_totals(_by_score(scored, score, by), _totals(scored, score, by), by)
    return ranked.select(
        *by, F.col("_s").alias("threshold"), _ratio(F.col("_cneg"), F.col("_nneg")).alias("fpr"),
        _ratio(F.col("_cpos"), F.col("_npos")).alias("tpr"),
    )


def detection_rate_by_attack(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of flagged windows per class; for Normal that is the false positive rate."""
    return classified.groupBy(*by, "attack_type").agg(
        F.avg("is_anomaly").alias("detection_rate"), F.count(F.lit(1)).alias("samples")
    )


def metrics_sampled(classified: DataFrame, size: int = fv.MAX_METRIC_ROWS, seed: int = fv.SEED) -> DataFrame:
    """Metrics on a draw of at most ``size`` windows."""
    drawn = sample_rows(classified, ["vehicle_id", "capture", "w"], size, seed)
    return classification_metrics(drawn).crossJoin(F.broadcast(roc_auc(drawn)))


def model_comparison(classified: DataFrame, by: str = "detector") -> DataFrame:
    """Detectors side by side, rank 1 = best F1. Input: one row per window and detector."""
    joined = classification_metrics(classified, [by])
    for extra in (roc_auc(classified, "score", [by]), average_precision(classified, "score", [by])):
        joined = joined.join(F.broadcast(extra), by, "left")
    return joined.withColumn("f1_rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("f1"), by)))


def improvement_ratio(old: DataFrame, new: DataFrame, metrics: Sequence[str] = ("precision", "recall", "f1")) -> DataFrame:
    """new/old - 1 per metric of two one-row metric tables."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"old_{m}").alias("old_value"), F.col(f"new_{m}").alias("new_value")) for m in metrics])
    both = old.select(*[F.col(m).alias(f"old_{m}") for m in metrics]).crossJoin(
        F.broadcast(new.select(*[F.col(m).alias(f"new_{m}") for m in metrics]))
    )
    return both.select(F.explode(pairs).alias("_p")).select("_p.*").withColumn(
        "improvement", F.try_divide(F.col("new_value"), F.col("old_value")) - 1
    )


def score_histogram(scored: DataFrame, score: str = "anomaly_score", bins: int = 80) -> DataFrame:
    """Windows per class in equal-width bins between the smallest and the largest score."""
    ends = scored.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    part = F.try_divide((F.col(score) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))
    bin_ = F.coalesce(F.least(F.floor(part).cast("int"), F.lit(bins - 1)), F.lit(0))
    return attach(scored.where(F.col(score).isNotNull()), ends).groupBy("attack_type", bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
