"""Queries over the fitted-model operators whose answers SQL can give too, each beside its SQL.

Models are small, or hold fixed numbers, so that an exact answer exists; the rows are the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.operators import attribution, clusters, encode, fitted, isotonic, lockstep, models
from riskweave.operators.features import build_features
from riskweave.operators.groups import exclusive_label
from riskweave.operators.newton import fit_logistics
from riskweave.plans import training
from riskweave.plans.oracle import _FEATURES, _SCORES, with_
from riskweave.session import fresh_path, materialise, ship
from riskweave.sources.adapter import patient_level, scores
from riskweave.sources.tables import optional_flag
from riskweave.streaming import outcomes
from riskweave.streaming.scoring import write_batches

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = ("Glaucoma only", "Diabetic only", "Glaucoma+Diabetic")
SPLIT_FEATURES = ("flag_ckd", "flag_hf", "flag_hypertension", "last_12months_chronic_count", "ADINatrank")
LEAST_ROWS = 20
_GROUP_SQL = """CASE WHEN flag_glaucoma = 1 AND flag_diabetes = 1 THEN 'Glaucoma+Diabetic' WHEN flag_glaucoma = 1 THEN 'Glaucoma only' ELSE 'Diabetic only' END"""


def _fits() -> dict[str, Column]:
    return {"all": F.lit(True)} | {g: F.col("subgroup") == g for g in GROUPS}


def _rows(spark: SparkSession, d: str, columns: tuple[str, ...], missing: float = -1.0) -> DataFrame:
    """Cohort rows with the named features as a vector, written; an unknown value is ``missing``."""
    rows = build_features(patient_level(spark, d)).withColumn("subgroup", exclusive_label())
    vector = array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns]))
    return materialise(rows.select("patientID", "Outcome", "subgroup", vector.alias("features")), "fixed-features")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- first splits of boosted trees ---------------------------------------------------------------


def tree_splits(spark: SparkSession, d: str) -> DataFrame:
    """The first split of a boosted model of all rows and of each group, all found in one job."""
    ship(spark)
    rows = _rows(spark, d, SPLIT_FEATURES)
    fits = list(_fits().values())
    counts = lockstep.fit_counts(rows, "Outcome", fits)
    bins = lockstep.fit_bins(rows, "patientID")
    blocks = lockstep.pack(rows, "patientID", "Outcome", fits, bins, int(counts.sum()))
    how = lockstep.BoostSettings(rounds=1, depth=1, columns=1.0, least_rows=LEAST_ROWS)
    # One job per level for all fits, whatever their size.
    grown = lockstep.boost(blocks, bins, counts, np.zeros(len(fits)), [len(SPLIT_FEATURES)] * len(fits), how, whole_rows=0)
    found = []
    for name, ensemble in zip(_fits(), grown):
        tree = ensemble.trees[0]
        f = int(tree.feature[0, 1])
        found.append((name, SPLIT_FEATURES[f], float(bins.edges[f][tree.bin[0, 1]]), int(tree.cover[0, 2]), int(tree.cover[0, 3]), float(tree.gain[0, 1])))
    made = spark.createDataFrame(found, "fit string, feature string, threshold double, n_left long, n_right long, gain double")
    return _rounded(made, 3, "gain")


def tree_splits_sql() -> str:
    columns = ", ".join(f"({i}, '{c}', coalesce(CAST({c} AS DOUBLE), -1))" for i, c in enumerate(SPLIT_FEATURES))
    return with_(
        _FEATURES,
        f"""
member AS (SELECT *, unnest(['all', {_GROUP_SQL}]) AS fit FROM feat),
size AS (SELECT fit, count(*) AS n, sum(Outcome) AS pos FROM member GROUP BY fit),
longer AS (
  SELECT fit, v.i AS i, v.name AS feature, v.x AS x, (0.5 - Outcome) * w AS g, CAST(0.25 AS DOUBLE) * w AS h
  FROM (SELECT m.*, CAST(n AS DOUBLE) / (2 * CASE WHEN Outcome = 1 THEN pos ELSE n - pos END) AS w FROM member m JOIN size USING (fit)),
  LATERAL (VALUES {columns}) v(i, name, x)),
runs AS (SELECT fit, i, feature, x, count(*) AS n, sum(g) AS g, sum(h) AS h FROM longer GROUP BY ALL),
cum AS (
  SELECT fit, i, feature, x, lead(x) OVER o AS next_x, sum(n) OVER o AS n_l, sum(g) OVER o AS g_l, sum(h) OVER o AS h_l,
    sum(n) OVER p AS n_t, sum(g) OVER p AS g_t, sum(h) OVER p AS h_t
  FROM runs WINDOW o AS (PARTITION BY fit, i ORDER BY x), p AS (PARTITION BY fit, i)),
gains AS (
  SELECT fit, i, feature, (x + next_x) / 2 AS threshold, CAST(n_l AS BIGINT) AS n_left, CAST(n_t - n_l AS BIGINT) AS n_right,
    g_l * g_l / h_l + (g_t - g_l) * (g_t - g_l) / (h_t - h_l) - g_t * g_t / h_t AS gain
  FROM cum WHERE next_x IS NOT NULL AND n_l >= {LEAST_ROWS} AND n_t - n_l >= {LEAST_ROWS})""",
        select="""SELECT fit, feature, threshold, n_left, n_right, round(gain, 3) AS gain FROM gains
QUALIFY row_number() OVER (PARTITION BY fit ORDER BY gain DESC, i, threshold) = 1""",
    )


# --- regressions -----------------------------------------------------------------------------------

NEWTON_C = 0.1
NEWTON_FEATURE = "last_12months_chronic_count"


def logistic_fits(spark: SparkSession, d: str) -> DataFrame:
    """A balanced, standardised, penalised regression of the outcome on one count, of all rows and of each group."""
    ship(spark)
    found = fit_logistics(_rows(spark, d, (NEWTON_FEATURE,)), "Outcome", list(_fits().values()), NEWTON_C)
    rows = [(name, float(f.coefficients[0]), f.intercept, float(f.mean[0]), float(f.deviation[0])) for name, f in zip(_fits(), found)]
    made = spark.createDataFrame(rows, "fit string, coefficient double, intercept double, mean double, deviation double")
    return _rounded(made, 6, "coefficient", "intercept", "mean", "deviation")


def logistic_fits_sql(steps: int = 8) -> str:
    ctes = [
        f"""
member AS (SELECT unnest(['all', {_GROUP_SQL}]) AS fit, CAST({NEWTON_FEATURE} AS DOUBLE) AS x, Outcome AS y FROM feat),
size AS (SELECT fit, count(*) AS n, sum(y) AS pos, avg(x) AS mean, stddev_pop(x) AS dev FROM member GROUP BY fit),
z AS MATERIALIZED (
  SELECT fit, (x - mean) / dev AS z, y, CAST(n AS DOUBLE) / (2 * CASE WHEN y = 1 THEN pos ELSE n - pos END) AS w, mean, dev
  FROM member JOIN size USING (fit)),
s0 AS MATERIALIZED (SELECT fit, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS a FROM size)"""
    ]
    for i in range(1, steps + 1):
        ctes.append(f"""
t{i} AS (SELECT fit, b, a, z, y, w, 1 / (1 + exp(-(b * z + a))) AS p FROM z JOIN s{i - 1} USING (fit)),
u{i} AS (
  SELECT fit, any_value(b) AS b, any_value(a) AS a, sum(w * p * (1 - p) * z * z) + {1 / NEWTON_C} AS h11, sum(w * p * (1 - p) * z) AS h12,
    sum(w * p * (1 - p)) AS h22, sum(w * (y - p) * z) - {1 / NEWTON_C} * any_value(b) AS g1, sum(w * (y - p)) AS g2
  FROM t{i} GROUP BY fit),
s{i} AS MATERIALIZED (
  SELECT fit, b + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b, a + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS a FROM u{i})""")
    return with_(
        _FEATURES, *ctes,
        select=f"""SELECT fit, round(b, 6) AS coefficient, round(a, 6) AS intercept, round(mean, 6) AS mean, round(dev, 6) AS deviation
FROM s{steps} JOIN size USING (fit)""",
    )


# --- isotonic blocks ---------------------------------------------------------------------------------


def isotonic_by_group(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(isotonic.isotonic_blocks(scores(spark, d), "y_prob", "y_true", ["subgroup"]), 10, "fitted")


def isotonic_by_group_sql() -> str:
    return with_(
        _SCORES,
        """
pts AS (SELECT subgroup, y_prob AS x, count(*) AS w, sum(y_true) AS s, row_number() OVER (PARTITION BY subgroup ORDER BY y_prob) AS i
  FROM sc GROUP BY subgroup, y_prob),
cum AS (SELECT *, sum(w) OVER (PARTITION BY subgroup ORDER BY i) AS cw, sum(s) OVER (PARTITION BY subgroup ORDER BY i) AS cs FROM pts),
spans AS (SELECT j.subgroup, j.i AS j, k.i AS k, CAST(k.cs - j.cs + j.s AS DOUBLE) / (k.cw - j.cw + j.w) AS a
  FROM cum j JOIN cum k ON j.subgroup = k.subgroup AND j.i <= k.i),
lows AS (SELECT subgroup, j, k AS i, min(a) OVER (PARTITION BY subgroup, j ORDER BY k DESC) AS lo FROM spans),
fit AS (SELECT p.subgroup, p.x, p.w, max(lo) AS f FROM lows JOIN pts p ON p.i = lows.i AND p.subgroup = lows.subgroup GROUP BY ALL)""",
        select="""SELECT subgroup, min(x) AS low, max(x) AS high, round(f, 10) AS fitted, CAST(sum(w) AS BIGINT) AS n FROM fit GROUP BY subgroup, f""",
    )


# --- clusters ------------------------------------------------------------------------------------------

CENTRES = (((0.3, 1.7), (7.1, 3.3), (4.9, 0.2)), ((9.2, 2.6), (1.1, 4.4), (5.3, 5.9)))


def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    """Rows, cost and means of the rows nearest to each fixed centre, of two restarts in one scan."""
    ship(spark)
    rows = _rows(spark, d, ("ADINatrank", "last_12months_chronic_count"))
    points = rows.select(F.array(vector_to_array("features")[0] / 10, vector_to_array("features")[1]).alias("x"))
    sums = clusters.lloyd_sums(points, np.array(CENTRES))
    made = [(r, c, int(v[0]), float(v[1]), float(v[2] / v[0]), float(v[3] / v[0])) for (r, c), v in sums.items()]
    return _rounded(spark.createDataFrame(made, "restart int, cluster int, n long, cost double, m1 double, m2 double"), 6, "cost", "m1", "m2")


def lloyd_step_sql() -> str:
    values = ", ".join(f"({r}, {c}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for r, cs in enumerate(CENTRES) for c, (x, y) in enumerate(cs))
    return with_(
        _FEATURES,
        f"""
points AS (SELECT patientID, coalesce(ADINatrank, -1) / 10 AS x, CAST(last_12months_chronic_count AS DOUBLE) AS y FROM feat),
near AS (
  SELECT restart, cluster, x, y, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d FROM points, (VALUES {values}) v(restart, cluster, cx, cy)
  QUALIFY row_number() OVER (PARTITION BY patientID, restart ORDER BY d, cluster) = 1)""",
        select="""SELECT CAST(restart AS INTEGER) AS restart, CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(sum(d), 6) AS cost,
  round(avg(x), 6) AS m1, round(avg(y), 6) AS m2 FROM near GROUP BY 1, 2""",
    )


def nearest_centre(spark: SparkSession, d: str) -> DataFrame:
    """Every row beside the number of its nearest centre."""
    rows = _rows(spark, d, ("ADINatrank", "last_12months_chronic_count"))
    points = rows.select("patientID", F.array(vector_to_array("features")[0] / 10, vector_to_array("features")[1]).alias("x"))
    return fitted.FittedCentres.of(np.array(CENTRES[0]), "x", "cluster").transform(points).select("patientID", "cluster")


def nearest_centre_sql() -> str:
    values = ", ".join(f"({c}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for c, (x, y) in enumerate(CENTRES[0]))
    return with_(
        _FEATURES,
        select=f"""SELECT patientID, CAST(cluster AS INTEGER) AS cluster FROM feat, (VALUES {values}) v(cluster, cx, cy)
QUALIFY row_number() OVER (PARTITION BY patientID ORDER BY
  (coalesce(ADINatrank, -1) / 10 - cx) * (coalesce(ADINatrank, -1) / 10 - cx) + (last_12months_chronic_count - cy) * (last_12months_chronic_count - cy), cluster) = 1""",
    )


# --- attribution ---------------------------------------------------------------------------------------

#: One tree: node, feature, threshold, children, value, cover.
TREE = ((0, 0, 2.5, 1, 2, 0.0, 100.0), (1, -1, 0.0, -1, -1, 0.125, 60.0), (2, 1, 50.5, 3, 4, 0.0, 40.0), (3, -1, 0.0, -1, -1, 0.5, 24.0), (4, -1, 0.0, -1, -1, 1.0, 16.0))


def tree_attribution_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Shapley values of every row under one fixed tree of two features."""
    nodes = spark.createDataFrame(
        [(0, i, v, c, left, right, f, t) for i, f, t, left, right, v, c in TREE],
        "treeID long, id long, value double, cover double, left long, right long, feature long, threshold double",
    )
    rows = _rows(spark, d, ("last_12months_chronic_count", "ADINatrank"))
    each = attribution.tree_contributions(nodes, rows)
    return _rounded(each.select("patientID", "expected", F.col("values")[0].alias("phi0"), F.col("values")[1].alias("phi1")), 10, "expected", "phi0", "phi1")


def tree_attribution_fixed_sql() -> str:
    return with_(
        _FEATURES,
        """
two AS (SELECT patientID, last_12months_chronic_count <= 2.5 AS few, coalesce(ADINatrank, -1) <= 50.5 AS mild FROM feat),
v AS (
  SELECT patientID, CAST(0.6 * 0.125 + 0.4 * (0.6 * 0.5 + 0.4) AS DOUBLE) AS v, CASE WHEN few THEN CAST(0.125 AS DOUBLE) ELSE 0.6 * 0.5 + 0.4 END AS v0,
    0.6 * 0.125 + 0.4 * CASE WHEN mild THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS v1, CASE WHEN few THEN CAST(0.125 AS DOUBLE) WHEN mild THEN 0.5 ELSE 1 END AS v01
  FROM two)""",
        select="""SELECT patientID, round(v, 10) AS expected, round(((v0 - v) + (v01 - v1)) / 2, 10) AS phi0, round(((v1 - v) + (v01 - v0)) / 2, 10) AS phi1 FROM v""",
    )


SLOPES = ((0, "flag_ckd", 0.5, 0.25), (1, "flag_hf", -2.0, 0.125), (2, "last_12months_chronic_count", 0.25, 2.0))


def strongest_features(spark: SparkSession, d: str) -> DataFrame:
    """The two features of largest mean absolute contribution to a fixed linear score."""
    rows = _rows(spark, d, tuple(s[1] for s in SLOPES))
    slopes = spark.createDataFrame(list(SLOPES), "pos int, feature string, slope double, mean double")
    return _rounded(attribution.strongest(attribution.linear_attribution(rows, slopes), 2), 10, "mean_abs_shap")


def strongest_features_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(abs(CAST({s} AS DOUBLE) * ({f} - CAST({m} AS DOUBLE)))), 10) AS mean_abs_shap FROM feat" for _, f, s, m in SLOPES)
    return with_(_FEATURES, select=f"SELECT * FROM ({parts}) ORDER BY mean_abs_shap DESC, feature LIMIT 2")


# --- scoring with models of fixed numbers ------------------------------------------------------------------


def _fixed(slope: float, offset: float) -> PipelineModel:
    numbers = {"slopes": [slope, -0.5], "offset": offset, "coefficients": [slope, -0.5], "means": [0.0, 0.0], "intercept": offset}
    return PipelineModel([fitted.FittedLinear().holding(numbers).named("gbt", "features")])


def specialised_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two of three groups by models of their own, put back together beside all rows: coverage and means."""
    rows = _rows(spark, d, ("last_12months_chronic_count", "flag_ckd"))
    own = {("subgroup = Glaucoma only", "gbt"): _fixed(0.25, -1.0), ("subgroup = Diabetic only", "gbt"): _fixed(-0.125, 0.5)}
    scored, _ = models.specialised_scores(rows, rows, "subgroup", GROUPS[:2], models.Settings(), 1, 1, fitted=own)
    whole = rows.select("patientID", "subgroup").join(scored.select("patientID", "p_special"), "patientID", "left")
    counted = whole.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n"), F.count("p_special").alias("covered"), F.avg("p_special").alias("mean"))
    return _rounded(counted, 10, "mean")


def specialised_fixed_sql() -> str:
    return with_(
        _FEATURES,
        f"""
own AS (SELECT {_GROUP_SQL} AS subgroup, last_12months_chronic_count AS x, flag_ckd AS c FROM feat),
p AS (SELECT subgroup, CASE subgroup WHEN 'Glaucoma only' THEN 1 / (1 + exp(-(CAST(0.25 AS DOUBLE) * x - 0.5 * c - 1)))
    WHEN 'Diabetic only' THEN 1 / (1 + exp(-(CAST(-0.125 AS DOUBLE) * x - 0.5 * c + 0.5))) END AS p FROM own)""",
        select="SELECT subgroup, count(*) AS n, count(p) AS covered, round(avg(p), 10) AS mean FROM p GROUP BY subgroup",
    )


def scoring_unit(spark: SparkSession, d: str) -> DataFrame:
    """Raw feature rows through one unit of fixed medians, vector and model, as a holdout goes."""
    encoding = encode.Encoding({"last_12months_chronic_count": 2.0, "ADINatrank": 50.0}, {})
    take = SQLTransformer(statement="SELECT *, prob_gbt AS p_vector FROM __THIS__")
    unit = PipelineModel([*encoding.stages(), *_fixed(0.03125, 0.25).stages, take])
    scored = training.score_rows(unit, build_features(patient_level(spark, d)))
    return _rounded(scored.select("patientID", vector_to_array("p_vector")[1].alias("p")), 10, "p")


def scoring_unit_sql() -> str:
    return with_(
        _FEATURES,
        select="""SELECT patientID, round(1 / (1 + exp(-(CAST(0.03125 AS DOUBLE) * last_12months_chronic_count - 0.5 * coalesce(ADINatrank, 50) + 0.25))), 10) AS p FROM feat""",
    )


def stacker_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Outcome as an integer, and the stacked vector's entries: probabilities, then their logits, by name."""
    rows = scores(spark, d).withColumn("y", F.col("y_true").cast("int"))
    stacked = models.stack_inputs(rows.select("patientID", "y", "p_logreg", "p_rf", "p_gbt"), ("logreg", "rf", "gbt"))
    entries = vector_to_array("stacked")
    return _rounded(stacked.select("patientID", "y", *[entries[i].alias(f"v{i}") for i in range(6)]), 6, *[f"v{i}" for i in range(6)])


def stacker_inputs_sql() -> str:
    names = ("p_logreg", "p_rf", "p_gbt")
    logits = [f"ln({p} / (1 - {p} + CAST(1e-9 AS DOUBLE)) + CAST(1e-9 AS DOUBLE))" for p in names]
    columns = ", ".join(f"round({e}, 6) AS v{i}" for i, e in enumerate([*names, *logits]))
    return with_(_SCORES, select=f"SELECT patientID, CAST(y_true AS INTEGER) AS y, {columns} FROM sc")


def optional_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the number of conditions they have, one of which the view does not know."""
    rows = build_features(patient_level(spark, d))
    flags = {"ckd": "flag_ckd", "hf": "flag_hf", "dialysis": "flag_dialysis"}
    held = rows.select(*[optional_flag(rows, c).cast("int").alias(n) for n, c in flags.items()])
    many = sum((F.col(n) for n in flags), F.lit(0)) >= 2
    return held.groupBy("ckd", "hf", "dialysis", many.alias("multi")).agg(F.count(F.lit(1)).alias("n"))


def optional_conditions_sql() -> str:
    return with_(
        _FEATURES, select="SELECT flag_ckd AS ckd, flag_hf AS hf, CAST(0 AS INTEGER) AS dialysis, flag_ckd + flag_hf >= 2 AS multi, count(*) AS n FROM feat GROUP BY 1, 2, 3, 4"
    )


# --- recurring jobs ------------------------------------------------------------------------------------

RECENT = 6


def calibration_state(spark: SparkSession, d: str) -> DataFrame:
    """Calibration sums of every month; the earlier and the later rows arrive as two states."""
    rows = scores(spark, d)
    parts = (isotonic.calibration_state(rows.filter(f"patientID % 2 = {i}"), "y_prob", "y_true", "EncMonth") for i in (0, 1))
    return isotonic.merged_states(*parts)


def calibration_state_sql() -> str:
    return with_(_SCORES, select="SELECT EncMonth AS month, y_prob AS score, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS positives FROM sc GROUP BY 1, 2")


def recalibrated(spark: SparkSession, d: str) -> DataFrame:
    """As of every month the isotonic fit of the last half year, from the months' sums alone."""
    return _rounded(isotonic.recalibrated(materialise(calibration_state(spark, d), "calibration-state"), RECENT), 10, "fitted")


def recalibrated_sql() -> str:
    return with_(
        _SCORES,
        f"""
numbered AS (SELECT EncMonth AS month, EncMonth // 100 * 12 + EncMonth % 100 - 1 AS m, y_prob, y_true FROM sc),
months AS (SELECT DISTINCT month, m AS a FROM numbered),
pts AS (
  SELECT t.month AS as_of, y_prob AS x, count(*) AS w, sum(y_true) AS s, row_number() OVER (PARTITION BY t.month ORDER BY y_prob) AS i
  FROM months t JOIN numbered r ON r.m BETWEEN t.a - {RECENT - 1} AND t.a GROUP BY t.month, y_prob),
cum AS (SELECT *, sum(w) OVER (PARTITION BY as_of ORDER BY i) AS cw, sum(s) OVER (PARTITION BY as_of ORDER BY i) AS cs FROM pts),
spans AS (SELECT j.as_of, j.i AS j, k.i AS k, CAST(k.cs - j.cs + j.s AS DOUBLE) / (k.cw - j.cw + j.w) AS a
  FROM cum j JOIN cum k ON j.as_of = k.as_of AND j.i <= k.i),
lows AS (SELECT as_of, j, k AS i, min(a) OVER (PARTITION BY as_of, j ORDER BY k DESC) AS lo FROM spans),
fit AS (SELECT p.as_of, p.x, p.w, max(lo) AS f FROM lows JOIN pts p ON p.i = lows.i AND p.as_of = lows.as_of GROUP BY ALL)""",
        select="SELECT as_of, min(x) AS low, max(x) AS high, round(f, 10) AS fitted, CAST(sum(w) AS BIGINT) AS n FROM fit GROUP BY as_of, f",
    )


#: Half a day off the dates, so that no date lies on the edge of what is still awaited.
AWAITED = "30 days 12 hours"


def late_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Scored orders joined with the first returned line shipped within a year, both as streams, by quarter."""
    orders = "o_orderkey bigint, o_orderdate timestamp_ntz"
    lines = "l_orderkey bigint, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz"
    day = lambda c: F.timestamp_seconds(F.unix_date(F.col(c).cast("date")).cast("bigint") * 86400)

    def scored(df: DataFrame) -> DataFrame:
        quarter = F.make_date(F.year("o_orderdate"), 3 * F.quarter("o_orderdate") - 2, F.lit(1))
        return df.select("o_orderkey", day("o_orderdate").alias("at"), (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("y_prob"), quarter.alias("quarter"))

    events = spark.readStream.schema(lines).parquet(f"{d}/lineitem*.parquet").filter("l_linenumber = 1 and l_returnflag = 'R'")
    events = events.select(F.col("l_orderkey").alias("o_orderkey"), day("l_shipdate").alias("observed"))
    arriving = scored(spark.readStream.schema(orders).parquet(f"{d}/orders*.parquet"))
    out, state = fresh_path(spark, "matured"), fresh_path(spark, "outcome-state")
    matured = outcomes.join_outcomes(arriving, events, "o_orderkey", "at", "observed", disorder=AWAITED)
    write_batches(matured.select("o_orderkey", "outcome"), out, state).awaitTermination()
    every = scored(spark.read.schema(orders).parquet(f"{d}/orders.parquet"))
    report = outcomes.maturity_report(every, spark.read.schema("o_orderkey bigint, outcome int").parquet(out), "o_orderkey", "quarter")
    return _rounded(report, 10, "mean_prob", "actual_rate", "cal_gap")


def late_outcomes_sql() -> str:
    return """
WITH events AS (SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'),
mark AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM events)) - INTERVAL '30 days 12 hours' AS w),
known AS (
  SELECT o_orderdate, CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000 AS p,
    CASE WHEN l_orderkey IS NOT NULL THEN 1 WHEN o_orderdate + INTERVAL 365 DAY < w THEN 0 END AS outcome
  FROM orders CROSS JOIN mark LEFT JOIN events ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 365 DAY)
SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, count(*) AS n, count(outcome) AS matured, count(*) - count(outcome) AS immature,
  CAST(sum(outcome) AS BIGINT) AS events, round(avg(p) FILTER (WHERE outcome IS NOT NULL), 10) AS mean_prob, round(avg(outcome), 10) AS actual_rate,
  round(avg(outcome) - avg(p) FILTER (WHERE outcome IS NOT NULL), 10) AS cal_gap
FROM known GROUP BY 1"""


_ALL: dict[str, tuple[Query, Callable[[], str]]] = {
    "tree_splits": (tree_splits, tree_splits_sql),
    "logistic_fits": (logistic_fits, logistic_fits_sql),
    "isotonic_by_group": (isotonic_by_group, isotonic_by_group_sql),
    "lloyd_step": (lloyd_step, lloyd_step_sql),
    "nearest_centre": (nearest_centre, nearest_centre_sql),
    "tree_attribution_fixed": (tree_attribution_fixed, tree_attribution_fixed_sql),
    "strongest_features": (strongest_features, strongest_features_sql),
    "specialised_fixed": (specialised_fixed, specialised_fixed_sql),
    "scoring_unit": (scoring_unit, scoring_unit_sql),
    "stacker_inputs": (stacker_inputs, stacker_inputs_sql),
    "missing_condition": (optional_conditions, optional_conditions_sql),
    "calibration_state": (calibration_state, calibration_state_sql),
    "recalibrated": (recalibrated, recalibrated_sql),
    "late_outcomes": (late_outcomes, late_outcomes_sql),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracles() -> dict[str, str]:
    return {name: sql() for name, (_, sql) in _ALL.items()}
