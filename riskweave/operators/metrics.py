"""Score evaluation: confusion counts, AUROC, average precision, Brier, MACE, lift.

All records are grouped: many subgroups cost one pass, not one pass each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweave.functions.columns import share
from riskweave.operators.ranking import KeyedCurve, keyed_curve, ntile_of, once, open_key, ranked_ties, tile_totals, top_count
from riskweave.session import materialise

# Bins of the calibration error and denominators of the top share.
CALIBRATION_BINS = 10
TOP_DENOMINATOR = 10
BIN_GAP_TOLERANCE = 0.05


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates of a confusion table; a rate over nothing is 0."""
    return {
        "sensitivity": share(tp, tp + fn),
        "specificity": share(tn, tn + fp),
        "ppv": share(tp, tp + fp),
        "npv": share(tn, tn + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
    }


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Confusion counts, prevalence and rates from a ready 0/1 prediction."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    extra = {"prevalence": share(tp + fn, F.col("n")), **rates(tp, fp, fn, tn)}
    return counted.select(*by, "n", "tp", "fp", "fn", "tn", *[c.alias(k) for k, c in extra.items()])


def evaluate(
    df: DataFrame,
    score: str = "y_prob",
    label: str = "y_true",
    tie: str = "patientID",
    by: Sequence[str] = (),
    threshold: float = 0.5,
    top: bool = True,
) -> DataFrame:
    """The full metric record, one row per group.

    Everything but the tied rows at the top-share cut comes from one curve of
    (score, count) pairs. AUROC counts ties as half; AUPRC is average precision
    (a step sum). Both are null for a group of one class, with ``status`` saying so.
    """
    df = once(df, score, label, tie, by) if top else df
    keyed = keyed_curve(df, score, label, by)
    curve = keyed.rows
    n, pos, s = F.col("n"), F.col("pos"), F.col("score")
    total, positives = F.col("n_total"), F.col("pos_total")
    neg = n - pos
    neg_below = (total - positives) - (F.col("cum_n") - F.col("cum_pos"))
    below = total - F.col("cum_n")
    # Bin of a quantile-binned score: edges below it, found from ranks alone.
    calibration_bin = F.when((below == 0) | (total == 1), 0).otherwise(
        F.least(F.lit(CALIBRATION_BINS - 1), F.floor((below * CALIBRATION_BINS - 1) / (total - 1)))
    )
    over = s >= F.lit(float(threshold))
    k = top_count(total, TOP_DENOMINATOR)
    before = F.col("cum_n") - n
    crossed = (before < k) & (F.col("cum_n") > k)
    zero = F.lit(0).cast("bigint")
    binned = curve.groupBy("__g", calibration_bin.alias("__bin")).agg(
        F.max(total).alias("n"),
        F.max(positives).alias("p"),
        F.sum(n).alias("bin_n"),
        F.sum(pos).alias("bin_pos"),
        F.sum(n * s).alias("bin_score"),
        F.sum(pos.cast("double") * (2 * neg_below + neg).cast("double")).alias("pairs"),
        F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("precision_steps"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("squares"),
        F.sum(F.when(over, n).otherwise(zero)).alias("flagged"),
        F.sum(F.when(over, pos).otherwise(zero)).alias("tp"),
        F.sum(F.when(F.col("cum_n") <= k, pos).otherwise(zero)).alias("top_pos"),
        # The one run that the top-share cut goes through, if any. Plain columns keep the
        # aggregation hashed; a struct would have it sort.
        F.max(F.when(crossed, s)).alias("score"),
        F.max(F.when(crossed, before)).alias("before"),
    )
    gap = F.abs(F.col("bin_pos") / F.col("bin_n") - F.col("bin_score") / F.col("bin_n"))
    sums = ["bin_score", "pairs", "precision_steps", "squares", "flagged", "tp", "top_pos"]
    record = binned.groupBy("__g").agg(
        F.max("n").alias("n"),
        F.max("p").alias("p"),
        F.avg(gap).alias("mace"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("score").alias("score"),
        F.max("before").alias("before"),
    )
    if top:
        record = materialise(record, "records")
        cut = record.filter(F.col("score").isNotNull()).select("__g", "score", "before", F.col("n").alias("n_total"))
        single = ranked_ties(df, score, label, tie, by, cut, keyed.straddlers(2))
        taken = F.col("before") + F.col("rank") <= top_count(F.col("n_total"), TOP_DENOMINATOR)
        edge = single.filter(taken).groupBy("__g").agg(F.sum("pos").alias("top_pos"))
        merged = record.drop("score", "before").unionByName(edge, allowMissingColumns=True).groupBy("__g")
        record = merged.agg(
            *[F.max(c).alias(c) for c in record.columns if c not in ("__g", "top_pos", "score", "before")],
            F.sum("top_pos").alias("top_pos"),
        )
    return open_key(_finish_record(record), by)


def _finish_record(record: DataFrame) -> DataFrame:
    n, p, tp = F.col("n"), F.col("p"), F.col("tp")
    fp, fn = F.col("flagged") - tp, p - tp
    tn = n - p - fp
    two_classes = (p > 0) & (p < n)
    k = top_count(n, TOP_DENOMINATOR)
    pairs = 2 * p.cast("double") * (n - p).cast("double")
    out = {
        "n": n,
        "events": p,
        "prevalence": share(p, n),
        "mean_score": F.col("bin_score") / n,
        "auroc": F.when(two_classes, F.try_divide(F.col("pairs"), pairs)),
        "auprc": F.when(two_classes, F.try_divide(F.col("precision_steps"), p.cast("double"))),
        "brier": F.col("squares") / n,
        "mace": F.col("mace"),
        **rates(tp, fp, fn, tn),
        "lift_top_decile": share(F.col("top_pos").cast("double") * n, k.cast("double") * p),
        "capture_top_decile": share(F.col("top_pos"), p),
        "tp": tp,
        "fp": fp,
        "fn": fn,
        "tn": tn,
        "status": F.when(two_classes, "ok").otherwise("one class"),
    }
    return record.select("__g", *[c.alias(name) for name, c in out.items()])


def quick_record(df: DataFrame, **kwargs) -> DataFrame:
    """AUROC, AUPRC, Brier and lift only; groups of one class are left out."""
    by = list(kwargs.get("by", ()))
    record = evaluate(df, **kwargs).filter(F.col("status") == "ok")
    return record.select(*by, "auroc", "auprc", "brier", "lift_top_decile")


def guarded(record: DataFrame, min_rows: int, rows: str = "n") -> DataFrame:
    """Mark groups too small to report instead of dropping them silently."""
    return record.withColumn(
        "status", F.when(F.col(rows) < min_rows, "too small").otherwise(F.col("status"))
    )


def score_models(
    df: DataFrame, models: dict[str, str], label: str = "y_true", tie: str = "patientID", threshold: float = 0.5
) -> DataFrame:
    """One record per model from score columns side by side, in one grouped job."""
    long = df.select(
        tie,
        label,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in models.items()])
        ).alias("__m"),
    ).select(tie, label, "__m.model", "__m.score")
    return evaluate(long, "score", label, tie, ["model"], threshold)


def compare_models(records: DataFrame) -> DataFrame:
    """Best AUROC first."""
    return records.orderBy(F.desc("auroc"), F.asc("model"))


def best_model(records: DataFrame) -> DataFrame:
    """One row: the model of highest AUROC (first by name among equals)."""
    return records.orderBy(F.desc("auroc"), F.asc("model")).limit(1)


def lift_table(
    df: DataFrame, score: str = "y_prob", label: str = "y_true", tie: str = "patientID", tiles: int = 10, curve: KeyedCurve | None = None
) -> DataFrame:
    """Per tile of the descending score: rows, events, rate and lift over the overall rate."""
    totals = tile_totals(df, score, label, tie, ntile_of(tiles), tiles, curve=curve)
    everything = Window.partitionBy()
    rate = F.col("pos") / F.col("n")
    overall = F.sum("pos").over(everything) / F.sum("n").over(everything)
    return totals.select(
        F.col("tile").alias("decile"),
        "n",
        F.col("pos").alias("n_events"),
        rate.alias("event_rate"),
        share(rate, overall).alias("lift"),
    ).orderBy("decile")


def tile_capture(
    df: DataFrame, score: str = "y_prob", label: str = "y_true", tie: str = "patientID", tiles: int = 10, curve: KeyedCurve | None = None
) -> DataFrame:
    """Share of all events that the first tile holds."""
    totals = tile_totals(df, score, label, tie, ntile_of(tiles), tiles, curve=curve)
    return totals.agg(
        share(F.sum(F.when(F.col("tile") == 1, F.col("pos")).otherwise(0)), F.sum("pos")).alias("capture")
    )


def calibration_table(
    df: DataFrame,
    score: str = "y_prob",
    label: str = "y_true",
    tie: str = "patientID",
    bins: int = CALIBRATION_BINS,
    tolerance: float = BIN_GAP_TOLERANCE,
    curve: KeyedCurve | None = None,
) -> DataFrame:
    """Per tile of the ascending score: mean predicted, mean actual, gap and flag."""
    totals = tile_totals(df, score, label, tie, ntile_of(bins), bins, descending=False, curve=curve)
    predicted, actual = F.col("score_sum") / F.col("n"), F.col("pos") / F.col("n")
    return totals.select(
        F.col("tile").alias("bin"),
        predicted.alias("mean_pred"),
        actual.alias("mean_actual"),
        "n",
        (actual - predicted).alias("gap"),
        (F.abs(actual - predicted) > tolerance).alias("flagged"),
    ).orderBy("bin")
