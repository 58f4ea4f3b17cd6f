"""The same answers in plain SQL, for checking on the supplied tables.

Written against the table definitions and not against the Spark code: ranks use
one global window, AUROC uses midranks, calibration bins use interpolated edges.
"""

from __future__ import annotations

_VISITS = """
visits AS (
  SELECT l_orderkey,
    count(*) AS v12,
    count(*) FILTER (WHERE l_linenumber <= 3) AS v6,
    count(DISTINCT l_suppkey % 6) AS s12,
    count(DISTINCT l_suppkey % 6) FILTER (WHERE l_linenumber <= 3) AS s6,
    count(*) FILTER (WHERE l_suppkey % 6 = 0) AS sp0,
    count(*) FILTER (WHERE l_suppkey % 6 = 1) AS sp1,
    count(*) FILTER (WHERE l_suppkey % 6 = 2) AS sp2,
    count(*) FILTER (WHERE l_suppkey % 6 = 3) AS sp3
  FROM lineitem GROUP BY l_orderkey
)"""

_BASE = """
raw AS (
  SELECT o.*, c.c_mktsegment, c.c_nationkey, r.r_name, o_orderkey AS k, o_custkey AS c
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
flagged AS (
  SELECT k AS patientID,
    CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS EncMonth,
    CASE WHEN k % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS Outcome,
    CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS glaucoma,
    CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER) AS diabetes,
    CAST(c % 4 = 0 AS INTEGER) AS blindness, CAST(c % 6 = 1 AS INTEGER) AS cataract,
    CAST(k % 2 = 0 AS INTEGER) AS hypertension, CAST(k % 3 = 1 AS INTEGER) AS obesity,
    CAST(c_nationkey % 3 = 0 AS INTEGER) AS ckd, CAST(c_nationkey % 5 = 0 AS INTEGER) AS hf,
    CAST(c % 9 = 0 AS INTEGER) AS ihd, CAST(k % 8 = 3 AS INTEGER) AS afib,
    CAST(k % 5 = 2 AS INTEGER) AS depression, CAST(c % 10 = 3 AS INTEGER) AS anxiety,
    CAST(c % 5 = 1 AS INTEGER) AS tobacco,
    CAST(k % 7 = 0 OR k % 11 = 3 OR k % 13 = 5 AS INTEGER) AS cancer,
    CASE WHEN k % 13 <> 0 THEN CAST(k % 101 AS DOUBLE) END AS adi,
    CASE WHEN k % 13 <> 0 THEN CAST(c % 10 + 1 AS DOUBLE) END AS adi_state,
    CASE WHEN c % 17 <> 0 THEN CAST(c % 101 AS DOUBLE) END AS cahpi,
    CASE WHEN k % 29 <> 0 THEN o_totalprice / 10000 END AS miles,
    CASE WHEN k % 13 <> 0 THEN CAST((k % 101) // 21 + 1 AS INTEGER) END AS adi_q,
    CASE WHEN c % 17 <> 0 THEN CAST((c % 101) // 26 + 1 AS INTEGER) END AS cahpi_q,
    CASE WHEN k % 11 <> 0 THEN c_mktsegment END AS race,
    CASE WHEN k % 19 <> 0 THEN r_name END AS marital,
    CASE WHEN k % 23 <> 0 THEN CASE WHEN c % 2 = 0 THEN 'Female' ELSE 'Male' END END AS sex
  FROM raw
),
pl AS (
  SELECT *, hypertension + obesity + ckd + hf + ihd + afib + depression AS chronic FROM flagged
)"""

_FEATURES = (
    _VISITS
    + ","
    + _BASE
    + """,
feat AS (
  SELECT patientID, EncMonth, Outcome,
    glaucoma AS flag_glaucoma, diabetes AS flag_diabetes, glaucoma * diabetes AS flag_glaucoma_diabetic,
    blindness AS flag_blindness, cataract AS flag_cataract, hypertension AS flag_hypertension,
    obesity AS flag_obesity, ckd AS flag_ckd, hf AS flag_hf, ihd AS flag_ihd, afib AS flag_afib,
    depression AS flag_depression, anxiety AS flag_anxiety, tobacco AS flag_tobacco, cancer AS flag_cancer,
    CAST(chronic + 2 * cataract + patientID % 4 AS INTEGER) AS last_12months_diagnosis_count_ccw,
    chronic AS last_12months_chronic_count,
    adi AS ADINatrank, adi_state AS ADIStaterank, cahpi AS CAHPIPercentile,
    round(miles, 6) AS straight_line_distance_miles, round(ln(1 + miles), 6) AS distance_log,
    CASE WHEN adi >= 80 THEN 1 ELSE 0 END AS high_deprivation,
    CASE WHEN cahpi <= 25 THEN 1 ELSE 0 END AS low_cahpi,
    CASE WHEN miles > 10 THEN 1 ELSE 0 END AS far_from_care,
    adi_q AS ADINatRankQuintile, cahpi_q AS CAHPIQuartile,
    CAST(coalesce(v12, 0) AS INTEGER) AS last_12months_officevisit_count,
    CAST(coalesce(v6, 0) AS INTEGER) AS last_6months_officevisit_count,
    CAST(coalesce(s12, 0) AS INTEGER) AS last_12months_officevisit_distinct_specialty,
    CAST(coalesce(s6, 0) AS INTEGER) AS last_6months_officevisit_distinct_specialty,
    round(coalesce(v6, 0) / (coalesce(v12, 0) + CAST(0.001 AS DOUBLE)), 6) AS op_recency_ratio,
    CASE WHEN coalesce(s12, 0) >= 3 THEN 1 ELSE 0 END AS high_specialty_breadth,
    CAST(coalesce(sp0, 0) AS INTEGER) AS Specialty_internal_medicine,
    CAST(coalesce(sp1, 0) AS INTEGER) AS Specialty_family_practice,
    CAST(coalesce(sp2, 0) AS INTEGER) AS Specialty_nephrology,
    CAST(coalesce(sp3, 0) AS INTEGER) AS Specialty_cardiology,
    round(coalesce(sp3, 0) / (coalesce(v12, 0) + CAST(0.001 AS DOUBLE)), 6) AS cardio_visit_ratio,
    race AS DerivedRaceEthnicity, marital AS MaritalStatus, sex
  FROM pl LEFT JOIN visits ON l_orderkey = patientID
  WHERE Outcome IS NOT NULL AND (glaucoma = 1 OR diabetes = 1)
)"""
)

_SCORES = (
    _BASE
    + """,
sc AS (
  SELECT *, Outcome AS y_true,
    CAST(patientID * 7919 % 1000 AS DOUBLE) / 1000 AS y_prob,
    CAST(patientID * 7919 % 1000 AS DOUBLE) / 1000 AS p_logreg,
    CAST(patientID * 104729 % 1009 AS DOUBLE) / 1009 AS p_rf,
    CAST(patientID * 1299709 % 499 AS DOUBLE) / 499 AS p_gbt,
    CASE WHEN patientID * 7919 % 1000 >= 500 THEN 1 ELSE 0 END AS y_pred,
    CASE WHEN glaucoma = 1 AND diabetes = 1 THEN 'Glaucoma+Diabetic'
         WHEN glaucoma = 1 THEN 'Glaucoma only' ELSE 'Diabetic only' END AS subgroup
  FROM pl WHERE Outcome IS NOT NULL AND (glaucoma = 1 OR diabetes = 1)
)"""
)

_RUBRIC = """
member AS (
  SELECT s.*, g.name AS grp FROM sc s, (VALUES ('CKD only'), ('HF only'), ('Cancer only'), ('Multi-condition'),
    ('CKD (any)'), ('HF (any)'), ('Cancer (any)')) g(name)
  WHERE CASE g.name
    WHEN 'CKD only' THEN ckd = 1 AND hf = 0 AND cancer = 0
    WHEN 'HF only' THEN hf = 1 AND ckd = 0 AND cancer = 0
    WHEN 'Cancer only' THEN cancer = 1 AND ckd = 0 AND hf = 0
    WHEN 'Multi-condition' THEN ckd + hf + cancer >= 2
    WHEN 'CKD (any)' THEN ckd = 1 WHEN 'HF (any)' THEN hf = 1 ELSE cancer = 1 END
)"""

_DIMENSIONS = """
dims AS (
  SELECT patientID, y_true, y_prob, 'Race/Ethnicity' AS dimension, race AS grp FROM sc WHERE race IS NOT NULL
  UNION ALL SELECT patientID, y_true, y_prob, 'Marital Status', marital FROM sc WHERE marital IS NOT NULL
  UNION ALL SELECT patientID, y_true, y_prob, 'Sex', sex FROM sc WHERE sex IS NOT NULL
  UNION ALL SELECT patientID, y_true, y_prob, 'ADI Quintile (deprivation)', CAST(adi_q AS VARCHAR) FROM sc WHERE adi_q IS NOT NULL
  UNION ALL SELECT patientID, y_true, y_prob, 'CAHPI Quartile', CAST(cahpi_q AS VARCHAR) FROM sc WHERE cahpi_q IS NOT NULL
)"""


_SPLIT = """
months AS (SELECT EncMonth, row_number() OVER (ORDER BY EncMonth) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT EncMonth FROM feat)),
split AS (SELECT EncMonth, CASE WHEN i <= (m * 85) // 100 THEN 'train' ELSE 'val' END AS split FROM months)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + select


def metric_ctes(source: str, by: str = "0", score: str = "y_prob") -> str:
    """CTE ``rec``: one record per group key ``g`` of the source."""
    return f"""
src AS (SELECT patientID, y_true, CAST({score} AS DOUBLE) AS p, {by} AS g FROM {source}),
tot AS (SELECT g, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS pos FROM src GROUP BY g),
ranked AS (
  SELECT s.*, n, pos,
    rank() OVER (PARTITION BY s.g ORDER BY p) + (count(*) OVER (PARTITION BY s.g, p) - 1) / 2.0 AS midrank,
    row_number() OVER (PARTITION BY s.g ORDER BY p DESC, patientID) AS rd,
    row_number() OVER (PARTITION BY s.g ORDER BY p, patientID) - 1 AS ra
  FROM src s JOIN tot t ON s.g = t.g
),
runs AS (SELECT g, p, count(*) AS rn, sum(y_true) AS rp FROM src GROUP BY g, p),
cums AS (
  SELECT *, sum(rn) OVER (PARTITION BY g ORDER BY p DESC) AS cn, sum(rp) OVER (PARTITION BY g ORDER BY p DESC) AS cp FROM runs
),
ap AS (SELECT g, sum(rp * CAST(cp AS DOUBLE) / cn) AS steps FROM cums GROUP BY g),
edge_points AS (
  SELECT g, j, max(CASE WHEN ra = (j * (n - 1)) // 10 THEN p END) AS lo,
    max(CASE WHEN ra = (j * (n - 1) + 9) // 10 THEN p END) AS hi, max((j * (n - 1)) % 10) AS rest
  FROM ranked, range(1, 10) t(j) GROUP BY g, j
),
edges AS (SELECT g, j, lo + (hi - lo) * (rest / 10.0) AS e FROM edge_points),
binned AS (
  SELECT r.g, r.p, r.rn, r.rp, count(e.j) FILTER (WHERE e.e < r.p) AS bin FROM runs r JOIN edges e ON r.g = e.g GROUP BY ALL
),
bins AS (
  SELECT g, bin, abs(CAST(sum(rp) AS DOUBLE) / sum(rn) - sum(rn * p) / sum(rn)) AS gap FROM binned GROUP BY g, bin
),
maces AS (SELECT g, avg(gap) AS mace FROM bins GROUP BY g),
counted AS (
  SELECT g, max(n) AS n, max(pos) AS pos, sum(midrank * y_true) AS ranksum, sum((p - y_true) * (p - y_true)) AS sq,
    sum(p) AS ps,
    count(*) FILTER (WHERE y_true = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y_true = 0 AND p >= 0.5) AS fp,
    count(*) FILTER (WHERE y_true = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y_true = 0 AND p < 0.5) AS tn,
    CAST(sum(CASE WHEN rd <= greatest(1, n // 10) THEN y_true ELSE 0 END) AS BIGINT) AS top_pos,
    greatest(1, max(n) // 10) AS k
  FROM ranked GROUP BY g
),
rec AS (
  SELECT c.g, ps / n AS mean_raw, (ranksum - pos * (pos + 1) / 2.0) / nullif(CAST(pos AS DOUBLE) * (n - pos), 0) AS auroc_raw,
    n, pos AS events, CAST(pos AS DOUBLE) / n AS prevalence, round(ps / n, 10) AS mean_score,
    CASE WHEN pos > 0 AND pos < n THEN round((ranksum - pos * (pos + 1) / 2.0) / (CAST(pos AS DOUBLE) * (n - pos)), 10) END AS auroc,
    CASE WHEN pos > 0 AND pos < n THEN round(steps / pos, 10) END AS auprc,
    round(sq / n, 10) AS brier, round(mace, 10) AS mace,
    coalesce(round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 10), 0) AS sensitivity,
    coalesce(round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 10), 0) AS specificity,
    coalesce(round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 10), 0) AS ppv,
    coalesce(round(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 10), 0) AS npv,
    coalesce(round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 10), 0) AS f1,
    coalesce(round((CAST(top_pos AS DOUBLE) * n) / nullif(CAST(k AS DOUBLE) * pos, 0), 10), 0) AS lift_top_decile,
    coalesce(round(CAST(top_pos AS DOUBLE) / nullif(pos, 0), 10), 0) AS capture_top_decile,
    tp, fp, fn, tn,
    CASE WHEN pos > 0 AND pos < n THEN 'ok' ELSE 'one class' END AS status
  FROM counted c JOIN ap ON c.g = ap.g JOIN maces m ON c.g = m.g
)"""


_RECORD = """n, events, round(prevalence, 10) AS prevalence, mean_score, auroc, auprc, brier, mace,
  sensitivity, specificity, ppv, npv, f1, lift_top_decile, capture_top_decile, tp, fp, fn, tn"""

_CURVE = """
runs AS (SELECT y_prob AS t, count(*) AS rn, CAST(sum(y_true) AS BIGINT) AS rp FROM sc GROUP BY y_prob),
curve AS (
  SELECT t, CAST(sum(rn) OVER w AS BIGINT) AS cn, CAST(sum(rp) OVER w AS BIGINT) AS cp,
    (SELECT count(*) FROM sc) AS n, (SELECT CAST(sum(y_true) AS BIGINT) FROM sc) AS pos
  FROM runs WINDOW w AS (ORDER BY t DESC)
)"""

_TILED = """
tiled AS (
  SELECT y_true, y_prob, ntile(10) OVER (ORDER BY y_prob DESC, patientID) AS d,
    ntile(10) OVER (ORDER BY y_prob, patientID) AS a FROM sc
)"""


def _gap(column: str, source: str) -> str:
    return with_(
        _SCORES,
        select=f"""SELECT {source} AS {column}, count(*) AS n, round(avg(y_true), 10) AS actual_rate,
  round(avg(y_prob), 10) AS mean_prob, round(avg(y_true) - avg(y_prob), 10) AS cal_gap,
  abs(avg(y_true) - avg(y_prob)) > 0.02 AS flagged
FROM sc GROUP BY {source}""",
    )


def profile_oracles() -> dict[str, str]:
    rate = "round(avg(CAST(Outcome AS DOUBLE)), 10) AS rate"
    correlated = {
        "r_adi": "ADINatrank", "r_cahpi": "CAHPIPercentile", "r_op12": "last_12months_officevisit_count",
        "r_glaucoma": "flag_glaucoma", "r_diabetes": "flag_diabetes", "r_glaucoma_diabetic": "flag_glaucoma_diabetic",
        "r_cardio": "Specialty_cardiology", "r_distance": "straight_line_distance_miles",
        "r_chronic_count": "last_12months_chronic_count",
    }
    corr = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(corr({c}, Outcome), 10) AS r FROM feat" for n, c in correlated.items()
    )
    nulls = {"null_adi": "adi", "null_cahpi": "cahpi", "null_dist": "miles", "null_race": "race", "null_target": "Outcome"}
    null_rows = " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 10) AS pct FROM pl"
        for n, c in nulls.items()
    )
    dims = {"ADINatRankQuintile": "adi_q", "DerivedRaceEthnicity": "race", "sex": "sex"}
    dim_rows = " UNION ALL ".join(
        f"SELECT '{n}' AS dimension, coalesce(CAST({c} AS VARCHAR), 'Unknown') AS grp, count(*) AS n, {rate} FROM pl GROUP BY {c}"
        for n, c in dims.items()
    )
    return {
        "cohort_summary": with_(_BASE, select=f"SELECT count(*) AS n, {rate}, CAST(sum(Outcome) AS BIGINT) AS events FROM pl"),
        "overlap_groups": with_(
            _BASE,
            select=f"""SELECT subgroup, count(*) AS n, {rate} FROM (
  SELECT 'Glaucoma' AS subgroup, Outcome FROM pl WHERE glaucoma = 1
  UNION ALL SELECT 'Diabetic', Outcome FROM pl WHERE diabetes = 1
  UNION ALL SELECT 'Glaucoma+Diabetic', Outcome FROM pl WHERE glaucoma = 1 AND diabetes = 1
  UNION ALL SELECT 'CKD', Outcome FROM pl WHERE ckd = 1
  UNION ALL SELECT 'Heart Failure', Outcome FROM pl WHERE hf = 1) GROUP BY subgroup""",
        ),
        "exclusive_groups": with_(
            _SCORES,
            select="SELECT subgroup, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS events, round(avg(y_true), 10) AS rate FROM sc GROUP BY subgroup",
        ),
        "rate_by_quintile": with_(_BASE, select=f"SELECT adi_q AS grp, count(*) AS n, {rate} FROM pl GROUP BY adi_q"),
        "rate_by_race": with_(_BASE, select=f"SELECT race AS grp, count(*) AS n, {rate} FROM pl GROUP BY race"),
        "rate_by_sex": with_(_BASE, select=f"SELECT sex AS grp, count(*) AS n, {rate} FROM pl GROUP BY sex"),
        "profile_by_dims": with_(_BASE, select=dim_rows),
        "null_profile": with_(_BASE, select=null_rows),
        "date_span": with_(
            _FEATURES,
            select="""SELECT min(d) AS earliest, max(d) AS latest, count(DISTINCT d) AS n_months
FROM (SELECT CAST(strptime(CAST(EncMonth AS VARCHAR), '%Y%m') AS DATE) AS d FROM feat)""",
        ),
        "correlations": with_(_FEATURES, select=corr),
        "flag_totals": with_(
            _FEATURES,
            select="""SELECT CAST(sum(flag_glaucoma) AS BIGINT) AS flag_glaucoma, CAST(sum(flag_diabetes) AS BIGINT) AS flag_diabetes,
  CAST(sum(flag_glaucoma_diabetic) AS BIGINT) AS flag_glaucoma_diabetic FROM feat""",
        ),
        "feature_view": with_(_FEATURES, select="SELECT * FROM feat"),
        "temporal_split": with_(
            _FEATURES, _SPLIT,
            select="SELECT f.patientID, f.EncMonth, s.split FROM feat f JOIN split s ON f.EncMonth = s.EncMonth",
        ),
        "split_summary": with_(
            _FEATURES, _SPLIT,
            select="""SELECT s.split, count(*) AS n, round(avg(Outcome), 10) AS rate,
  CAST(strptime(CAST(min(f.EncMonth) AS VARCHAR), '%Y%m') AS DATE) AS first_month,
  CAST(strptime(CAST(max(f.EncMonth) AS VARCHAR), '%Y%m') AS DATE) AS last_month
FROM feat f JOIN split s ON f.EncMonth = s.EncMonth GROUP BY s.split""",
        ),
    }


def score_oracles() -> dict[str, str]:
    rates = """coalesce(round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 10), 0) AS sensitivity,
  coalesce(round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 10), 0) AS specificity,
  coalesce(round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 10), 0) AS ppv,
  coalesce(round(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 10), 0) AS npv,
  coalesce(round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 10), 0) AS f1"""
    cells = """count(*) AS n, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
  count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn,
  count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn"""
    overall = with_(_SCORES, metric_ctes("sc"), select=f"SELECT {_RECORD} FROM rec")
    one = lambda c: with_(_SCORES, metric_ctes("sc"), select=f"SELECT n, events, {c} FROM rec")
    models = """
long AS (
  SELECT patientID, y_true, 'logreg' AS model, p_logreg AS p0 FROM sc
  UNION ALL SELECT patientID, y_true, 'rf', p_rf FROM sc UNION ALL SELECT patientID, y_true, 'gbt', p_gbt FROM sc
)"""
    equity = """
eq AS (
  SELECT split_part(g, '|', 1) AS dimension, split_part(g, '|', 2) AS "group", n, round(prevalence, 3) AS prevalence,
    round(auroc_raw, 4) AS auroc, round(mean_raw, 4) AS mean_score FROM rec WHERE n >= 30 AND status = 'ok'
)"""
    eq_src = metric_ctes("dims", "dimension || '|' || grp")
    return {
        "confusion_overall": with_(
            _SCORES, select=f"SELECT n, tp, fp, fn, tn, round(CAST(tp + fn AS DOUBLE) / n, 10) AS prevalence, {rates} FROM (SELECT {cells} FROM sc)"
        ),
        "confusion_by_group": with_(
            _SCORES,
            select=f"""SELECT subgroup, n, tp, fp, fn, tn, round(CAST(tp + fn AS DOUBLE) / n, 10) AS prevalence, {rates}
FROM (SELECT subgroup, {cells} FROM sc GROUP BY subgroup)""",
        ),
        "decile_lift": with_(
            _SCORES, _TILED,
            select="""SELECT CAST(d AS INTEGER) AS decile, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS n_events,
  round(avg(y_true), 10) AS event_rate, round(avg(y_true) / (SELECT avg(y_true) FROM sc), 10) AS lift FROM tiled GROUP BY d""",
        ),
        "decile_capture": with_(
            _SCORES, _TILED,
            select="SELECT round(sum(CASE WHEN d = 1 THEN y_true ELSE 0 END) * 1.0 / sum(y_true), 10) AS capture FROM tiled",
        ),
        "calibration_bins": with_(
            _SCORES, _TILED,
            select="""SELECT CAST(a AS INTEGER) AS bin, round(avg(y_prob), 10) AS mean_pred, round(avg(y_true), 10) AS mean_actual, count(*) AS n,
  round(avg(y_true) - avg(y_prob), 10) AS gap, abs(avg(y_true) - avg(y_prob)) > 0.05 AS flagged FROM tiled GROUP BY a""",
        ),
        "global_ntile": with_(
            _SCORES,
            select="SELECT patientID, y_prob, CAST(ntile(7) OVER (ORDER BY y_prob DESC, patientID) AS INTEGER) AS tile FROM sc",
        ),
        "global_row_number": with_(
            _SCORES,
            select="""SELECT subgroup, patientID, y_prob, row_number() OVER (PARTITION BY subgroup ORDER BY y_prob DESC, patientID) AS rn,
  count(*) OVER (PARTITION BY subgroup) AS n FROM sc""",
        ),
        "auroc": one("auroc"),
        "auprc": one("auprc"),
        "brier": one("brier"),
        "mace": one("mace"),
        "topk_lift": one("lift_top_decile, capture_top_decile"),
        "metrics_full": overall,
        "quick_record": with_(_SCORES, metric_ctes("sc"), select="SELECT auroc, auprc, brier, lift_top_decile FROM rec"),
        "group_metrics": with_(
            _SCORES, metric_ctes("sc", "subgroup"),
            select=f"SELECT g AS subgroup, {_RECORD}, CASE WHEN n < 30 THEN 'too small' ELSE status END AS status FROM rec",
        ),
        "rubric_metrics": with_(
            _SCORES, _RUBRIC, metric_ctes("member", "grp"),
            select=f"SELECT g AS subgroup, {_RECORD}, CASE WHEN n < 20 THEN 'too small' ELSE status END AS status FROM rec",
        ),
        "model_records": with_(
            _SCORES, models, metric_ctes("long", "model", "p0"), select=f"SELECT g AS model, {_RECORD}, status FROM rec"
        ),
        "best_model": with_(
            _SCORES, models, metric_ctes("long", "model", "p0"),
            select="SELECT g AS model, auroc FROM rec ORDER BY auroc DESC, g LIMIT 1",
        ),
        "equity_table": with_(_SCORES, _DIMENSIONS, eq_src, equity, select="SELECT * FROM eq"),
        "equity_gap": with_(
            _SCORES, _DIMENSIONS, eq_src, equity,
            select="""SELECT dimension, count(*) AS groups, round(max(auroc) - min(auroc), 4) AS auroc_gap,
  round(max(auroc) - min(auroc), 4) >= 0.05 AS flagged FROM eq GROUP BY dimension""",
        ),
        "calibration_gap_race": _gap("DerivedRaceEthnicity", "race"),
        "calibration_gap_adi": _gap("ADINatRankQuintile", "adi_q"),
        "pr_curve": with_(
            _SCORES, _CURVE,
            select="""SELECT t AS threshold, cp AS tp, cn - cp AS fp, round(CAST(cp AS DOUBLE) / cn, 10) AS precision,
  round(CAST(cp AS DOUBLE) / pos, 10) AS recall FROM curve""",
        ),
        "threshold_table": with_(
            _SCORES, _CURVE,
            """
hit AS (
  SELECT target, max(t) AS t FROM curve, (VALUES (0.5), (0.4), (0.3), (0.2)) v(target)
  WHERE CAST(cp AS DOUBLE) / pos >= CAST(target AS DOUBLE) GROUP BY target
),
points AS (
  SELECT 'sensitivity' AS kind, CAST(target AS DOUBLE) AS target, t FROM hit h
  WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.target > h.target AND round(o.t, 3) = round(h.t, 3))
  UNION ALL SELECT 'top_cut', NULL, quantile_cont(y_prob, 0.9) FROM sc
  UNION ALL SELECT 'recommended', 0.3, coalesce((SELECT t FROM hit WHERE target = 0.3), (SELECT quantile_cont(y_prob, 0.9) FROM sc))
),
counted AS (
  SELECT kind, target, t, count(*) AS n, count(*) FILTER (WHERE y_true = 1 AND y_prob >= t) AS tp,
    count(*) FILTER (WHERE y_true = 0 AND y_prob >= t) AS fp, count(*) FILTER (WHERE y_true = 1 AND y_prob < t) AS fn,
    count(*) FILTER (WHERE y_true = 0 AND y_prob < t) AS tn FROM sc, points GROUP BY kind, target, t
)""",
            select="""SELECT kind, target, round(t, 10) AS threshold, tp, fp, fn, tn,
  round(CAST(tp AS DOUBLE) / (tp + fn), 10) AS sensitivity, round(CAST(tn AS DOUBLE) / (tn + fp), 10) AS specificity,
  round(CAST(tp AS DOUBLE) / (tp + fp), 10) AS ppv, round(2.0 * tp / (2 * tp + fp + fn), 10) AS f1,
  round((tp + fp) * 100.0 / n, 10) AS flagged_pct, round(CAST(tp + fp AS DOUBLE) / tp, 10) AS contacts_per_event FROM counted""",
        ),
    }


_TRAIN = """
months AS (SELECT EncMonth, row_number() OVER (ORDER BY EncMonth) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT EncMonth FROM feat)),
train AS (SELECT * FROM feat WHERE EncMonth IN (SELECT EncMonth FROM months WHERE i <= (m * 85) // 100))"""

# Exact inputs for medians: the rounding of the feature view must not show.
_NUMERIC = [
    "flag_blindness", "flag_cataract", "flag_hypertension", "flag_obesity", "flag_ckd", "flag_hf", "flag_ihd", "flag_afib",
    "flag_depression", "flag_anxiety", "flag_tobacco", "flag_cancer",
    "last_12months_diagnosis_count_ccw", "last_12months_chronic_count",
    "ADINatrank", "ADIStaterank", "CAHPIPercentile", "straight_line_distance_miles", "distance_log",
    "high_deprivation", "low_cahpi", "far_from_care",
    "last_12months_officevisit_count", "last_6months_officevisit_count",
    "last_12months_officevisit_distinct_specialty", "last_6months_officevisit_distinct_specialty",
    "op_recency_ratio", "high_specialty_breadth",
    "Specialty_internal_medicine", "Specialty_family_practice", "Specialty_nephrology", "Specialty_cardiology",
    "cardio_visit_ratio",
]


def _unrounded(ctes: str) -> str:
    return (
        ctes.replace("round(miles, 6)", "miles")
        .replace("round(ln(1 + miles), 6)", "ln(1 + miles)")
        .replace("round(coalesce(v6, 0) / (coalesce(v12, 0) + CAST(0.001 AS DOUBLE)), 6)", "coalesce(v6, 0) / (coalesce(v12, 0) + CAST(0.001 AS DOUBLE))")
        .replace("round(coalesce(sp3, 0) / (coalesce(v12, 0) + CAST(0.001 AS DOUBLE)), 6)", "coalesce(sp3, 0) / (coalesce(v12, 0) + CAST(0.001 AS DOUBLE))")
    )


def matrix_oracles() -> dict[str, str]:
    features = _unrounded(_FEATURES)
    medians = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(median(CAST({c} AS DOUBLE)), 10) AS median FROM train" for c in _NUMERIC
    )
    filled = ", ".join(
        f"round(coalesce({c}, (SELECT median({c}) FROM train)), 10) AS {c}"
        for c in ("ADINatrank", "CAHPIPercentile", "straight_line_distance_miles")
    )
    # Sorted levels without the first, then the null column.
    levels = {
        "DerivedRaceEthnicity": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "MaritalStatus": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
        "sex": ["Male"],
    }
    hot = ", ".join(
        ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"{c}_{v}\"" for v in vs)
        + f", CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}_nan"
        for c, vs in levels.items()
    )
    isotonic = """
halves AS (SELECT patientID, y_prob, y_true, row_number() OVER (ORDER BY EncMonth, patientID) <= count(*) OVER () // 2 AS cal FROM sc),
pts AS (SELECT y_prob AS x, count(*) AS w, sum(y_true) AS s, row_number() OVER (ORDER BY y_prob) AS i FROM halves WHERE cal GROUP BY y_prob),
cum AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) AS cs FROM pts),
spans AS (SELECT j.i AS j, k.i AS k, CAST(k.cs - j.cs + j.s AS DOUBLE) / (k.cw - j.cw + j.w) AS a FROM cum j JOIN cum k ON j.i <= k.i),
lows AS (SELECT j, k AS i, min(a) OVER (PARTITION BY j ORDER BY k DESC) AS lo FROM spans),
fit AS (SELECT p.x, max(lo) AS f FROM lows JOIN pts p ON p.i = lows.i GROUP BY p.x),
asked AS (SELECT DISTINCT y_prob AS p FROM halves WHERE NOT cal),
ends AS (
  SELECT p, max(x) FILTER (WHERE x <= p) AS x0, min(x) FILTER (WHERE x >= p) AS x1 FROM asked, fit GROUP BY p
),
answer AS (
  SELECT p, CASE WHEN x0 IS NULL THEN b.f WHEN x1 IS NULL THEN a.f WHEN x1 = x0 THEN a.f
    ELSE a.f + (b.f - a.f) * (p - x0) / (x1 - x0) END AS v
  FROM ends LEFT JOIN fit a ON a.x = x0 LEFT JOIN fit b ON b.x = x1
)"""
    return {
        "medians": with_(features, _TRAIN, select=medians),
        "encoded_features": with_(features, _TRAIN, select=f"SELECT patientID, {filled}, {hot} FROM feat"),
        "class_weights": with_(
            _FEATURES,
            select="""SELECT Outcome, count(*) AS n, round((SELECT count(*) FROM feat) / (2.0 * count(*)), 10) AS weight
FROM feat GROUP BY Outcome""",
        ),
        "aligned_columns": with_(
            _BASE, select="SELECT patientID, EncMonth, CAST(0 AS DOUBLE) AS Specialty_cardiology FROM pl"
        ),
        "calibration_half": with_(
            _SCORES,
            select="""SELECT patientID, EncMonth, CASE WHEN row_number() OVER (ORDER BY EncMonth, patientID) <= count(*) OVER () // 2
  THEN 'calibrate' ELSE 'evaluate' END AS half FROM sc""",
        ),
        "isotonic_scores": with_(
            _SCORES, isotonic,
            select="SELECT patientID, y_prob, round(v, 10) AS p_cal FROM halves JOIN answer ON p = y_prob WHERE NOT cal",
        ),
        "logit": with_(
            _SCORES,
            select="""SELECT patientID, round(ln(p_rf / (1 - p_rf + CAST(1e-9 AS DOUBLE)) + CAST(1e-9 AS DOUBLE)), 6) AS l_rf,
  CASE WHEN p_rf >= 0.25 THEN 1 ELSE 0 END AS over FROM sc""",
        ),
        "risk_level": with_(
            _SCORES,
            select="""SELECT subgroup, CASE WHEN p_gbt >= 0.15 THEN 'high' WHEN p_gbt >= 0.07 THEN 'moderate' ELSE 'low' END AS level,
  count(*) AS n FROM sc GROUP BY ALL""",
        ),
    }


_LONG = """
long AS (
  SELECT subgroup, EncMonth, 'logreg' AS model, p_logreg AS p FROM sc
  UNION ALL SELECT subgroup, EncMonth, 'rf', p_rf FROM sc UNION ALL SELECT subgroup, EncMonth, 'gbt', p_gbt FROM sc
),
monthly AS (SELECT subgroup, model, EncMonth, count(*) AS n, avg(p) AS v FROM long GROUP BY ALL),
points AS (
  SELECT subgroup, model, round(v, 4) AS v, 7 - row_number() OVER (PARTITION BY subgroup, model ORDER BY EncMonth DESC) AS place FROM monthly
),
trend AS (
  SELECT subgroup, model, max(v) FILTER (WHERE place = 1) AS t1, max(v) FILTER (WHERE place = 2) AS t2, max(v) FILTER (WHERE place = 3) AS t3,
    max(v) FILTER (WHERE place = 4) AS t4, max(v) FILTER (WHERE place = 5) AS t5, max(v) FILTER (WHERE place = 6) AS t6
  FROM points WHERE place BETWEEN 1 AND 6 GROUP BY ALL
),
cm AS (
  SELECT subgroup, model, risk_score, CASE WHEN risk_score >= 0.15 THEN 'high' WHEN risk_score >= 0.07 THEN 'moderate' ELSE 'low' END AS risk_level,
    t1, t2, t3, t4, t5, t6
  FROM (SELECT subgroup, model, round(avg(p), 4) AS risk_score FROM long GROUP BY ALL) JOIN trend USING (subgroup, model)
),
burden AS (
  SELECT subgroup, count(*) AS population, round(avg(chronic) / greatest((SELECT max(chronic) FROM sc), 1), 3) AS disease_burden
  FROM sc GROUP BY subgroup
),
cfg AS (
  SELECT * FROM (VALUES ('Glaucoma only', 'cohort_glaucoma', 'Glaucoma', 'optic_nerve'),
    ('Diabetic only', 'cohort_diabetic', 'Diabetic', 'retinal'),
    ('Glaucoma+Diabetic', 'cohort_glaucoma_diabetic', 'Glaucoma + Diabetic', 'retinal')) t(subgroup, id, name, category)
),
dc AS (
  SELECT *, CAST(floor(t1 * 100 + 0.5) AS INTEGER) || '%' AS p1, CAST(floor(t6 * 100 + 0.5) AS INTEGER) || '%' AS p6,
    CAST(floor(risk_score * 100 + 0.5) AS INTEGER) || '%' AS risk_pct,
    CASE WHEN max(disease_burden) OVER () = min(disease_burden) OVER () THEN 'risk score' ELSE 'disease burden' END AS depth_basis,
    CASE WHEN max(disease_burden) OVER () = min(disease_burden) OVER ()
      THEN (risk_score - min(risk_score) OVER ()) / CASE WHEN max(risk_score) OVER () = min(risk_score) OVER () THEN 1 ELSE max(risk_score) OVER () - min(risk_score) OVER () END
      ELSE (disease_burden - min(disease_burden) OVER ()) / (max(disease_burden) OVER () - min(disease_burden) OVER ()) END AS depth
  FROM cfg JOIN burden USING (subgroup) JOIN cm USING (subgroup) WHERE model = 'rf'
)"""


def export_oracles() -> dict[str, str]:
    return {
        "monthly_trend": with_(_SCORES, _LONG, select="SELECT subgroup, model, EncMonth, n, round(v, 10) AS mean_score FROM monthly"),
        "disease_burden": with_(_SCORES, _LONG, select="SELECT * FROM burden"),
        "cohort_models": with_(_SCORES, _LONG, select="SELECT * FROM cm"),
        "document_flat": with_(
            _SCORES, _LONG,
            select="""SELECT id, name, category, population, disease_burden, model, model = 'rf' AS is_default, risk_score, risk_level,
  t6 AS latest, 6 AS points FROM cfg JOIN burden USING (subgroup) JOIN cm USING (subgroup)""",
        ),
        "normalised_burden": with_(
            _SCORES, _LONG,
            select="SELECT id, population, disease_burden, depth_basis, round(depth, 10) AS normalized_disease_burden FROM dc",
        ),
        "cohort_panel": with_(
            _SCORES, _LONG,
            select="""SELECT id, upper(name) AS heading, risk_pct || ' ' || risk_level || ' risk · ' || population || ' patients' AS risk_line,
  CAST(floor(1 / risk_score + 0.5) AS BIGINT) AS one_in,
  CASE WHEN t6 > t1 THEN 'worsening' WHEN t6 < t1 THEN 'improving' ELSE 'flat' END AS direction,
  'Pulse shows trend direction: ' || CASE WHEN t6 > t1 THEN 'worsening' ELSE 'stable or improving' END || ' from ' || p1 || ' to ' || p6 || '.' AS pulse,
  'Center distance uses normalized ' || depth_basis || ': ' || CAST(floor(depth * 100 + 0.5) AS INTEGER)
    || '%. Closer to center means higher burden or risk in this dataset.' AS depth,
  'now,+2m,+5m,+7m,+10m,+12m' AS timeline FROM dc""",
        ),
        "insights": with_(
            _SCORES, _LONG,
            select="""SELECT id, 'summary' AS source, name || ' cohort: ' || risk_pct || ' predicted 12-month admission risk across ' || population
    || ' patients. Risk level is ' || risk_level || ' relative to the full cohort.' AS summary,
  'Feature importance not available for this model type.' AS drivers,
  'Six-point trend is ' || CASE WHEN t6 > t1 THEN 'worsening from ' || p1 || ' to ' || p6 WHEN t6 < t1 THEN 'improving from ' || p1 || ' to ' || p6
    ELSE 'flat at ' || p6 END || '. Each point represents a rolling risk estimate across the observation window.' AS trendInterpretation,
  2 AS caveats, 'ok' AS status FROM dc""",
        ),
        "cohort_lookup": with_(
            _SCORES, _LONG, select="SELECT id, name, population, risk_score FROM dc WHERE id = 'cohort_diabetic'"
        ),
    }


def recurring_oracles() -> dict[str, str]:
    return {
        "monthly_worklist": with_(
            _SCORES,
            """
placed AS (
  SELECT patientID, EncMonth, y_prob, row_number() OVER (PARTITION BY EncMonth ORDER BY y_prob DESC, patientID) AS place,
    count(*) OVER (PARTITION BY EncMonth) AS n FROM sc
)""",
            select="""SELECT patientID, EncMonth, y_prob, place,
  CASE WHEN y_prob >= 0.15 THEN 'high' WHEN y_prob >= 0.07 THEN 'moderate' ELSE 'low' END AS level
FROM placed WHERE place <= n * 15 // 100""",
        ),
        "audit_stream": """
SELECT CAST(time_bucket(INTERVAL 90 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS DATE) AS period_start,
  CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex, count(*) AS n,
  round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 10) AS actual_rate,
  round(avg(CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000), 10) AS mean_prob,
  round(avg(CAST(o_orderstatus = 'F' AS INTEGER)) - avg(CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000), 10) AS cal_gap,
  abs(avg(CAST(o_orderstatus = 'F' AS INTEGER)) - avg(CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000)) > 0.02 AS flagged
FROM orders GROUP BY 1, 2""",
    }


_NAMES = "CASE feature WHEN 'flag_ckd' THEN 'Chronic Kidney Disease' WHEN 'flag_hf' THEN 'Heart Failure' WHEN 'flag_cancer' THEN 'Cancer' ELSE feature END"

_IMPORTANCE = """
importance AS (
  SELECT m.model, f.feature, avg(CASE m.model WHEN 'logreg' THEN p_logreg WHEN 'rf' THEN p_rf ELSE p_gbt END
    * CASE f.feature WHEN 'flag_ckd' THEN ckd WHEN 'flag_hf' THEN hf WHEN 'flag_cancer' THEN cancer ELSE 1 END) AS importance
  FROM sc, (VALUES ('logreg'), ('rf'), ('gbt')) m(model), (VALUES ('flag_ckd'), ('flag_hf'), ('flag_cancer'), ('N/A')) f(feature)
  GROUP BY ALL
),
best AS (
  SELECT model, place, feature, round(importance / (sum(importance) OVER (PARTITION BY model) + 1e-9), 3) AS importance
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC) - 1 AS place FROM importance) WHERE place < 3
)"""


def fixed_oracles() -> dict[str, str]:
    profile = " UNION ALL ".join(
        f"SELECT CAST(patientID % 4 AS INTEGER) AS cluster, '{c}' AS feature, round(avg({c}), 10) AS mean FROM feat GROUP BY 1"
        for c in (
            "flag_glaucoma", "flag_diabetes", "flag_glaucoma_diabetic", "flag_ckd", "flag_hf", "flag_hypertension", "flag_depression",
            "ADINatrank", "CAHPIPercentile", "last_12months_officevisit_count", "last_12months_chronic_count",
        )
    )
    two = "g AS (WITH {} SELECT * FROM rec), s AS (WITH {} SELECT * FROM rec)".format(
        metric_ctes("sc", "subgroup", "p_rf"), metric_ctes("sc", "subgroup", "p_gbt")
    )
    parts = """
parts AS (
  SELECT patientID, y_true, p_rf AS y_prob, 'Overall' AS part FROM sc UNION ALL SELECT patientID, y_true, p_rf, subgroup FROM sc
)"""
    slopes = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, round(avg(abs({slope} * ({column} - {mean}))), 10) AS mean_abs_shap FROM sc"
        for name, column, slope, mean in (
            ("flag_ckd", "ckd", "CAST(0.5 AS DOUBLE)", "CAST(0.25 AS DOUBLE)"), ("flag_hf", "hf", "CAST(-2 AS DOUBLE)", "CAST(0.125 AS DOUBLE)"),
            ("last_12months_chronic_count", "chronic", "CAST(0.25 AS DOUBLE)", "CAST(2 AS DOUBLE)"),
        )
    )
    return {
        "global_row_number_wide": with_(
            _SCORES,
            select="""SELECT patientID, 1152921504606846976 + patientID % 5000 AS score,
  row_number() OVER (ORDER BY patientID % 5000 DESC, patientID) AS rn FROM sc""",
        ),
        "specialised_verdicts": with_(
            _SCORES, two,
            select="""SELECT g.g AS subgroup, round(g.auroc_raw, 4) AS general_auroc, round(g.auprc, 4) AS general_auprc,
  round(s.auroc_raw, 4) AS specialized_auroc, round(s.auprc, 4) AS specialized_auprc, round(s.auroc_raw - g.auroc_raw, 4) AS auroc_delta,
  CASE WHEN s.auroc_raw - g.auroc_raw > 0.01 THEN 'specialize' ELSE 'general_sufficient' END AS recommendation,
  CASE WHEN s.auroc_raw - g.auroc_raw > 0.01 THEN 'specialize' WHEN s.auroc_raw - g.auroc_raw >= -0.01 THEN 'general sufficient'
    ELSE 'general better' END AS verdict,
  CASE WHEN round(s.auroc_raw - g.auroc_raw, 4) > 0.01 THEN 'adopt' WHEN round(s.auroc_raw - g.auroc_raw, 4) > 0 THEN 'marginal' ELSE 'no gain' END AS cluster_verdict
FROM g LEFT JOIN s ON g.g = s.g""",
        ),
        "cluster_sizes_fixed": with_(
            _FEATURES, _SPLIT,
            select="""SELECT CAST(patientID % 4 AS INTEGER) AS cluster, count(*) FILTER (WHERE s.split = 'train') AS n_train,
  count(*) FILTER (WHERE s.split = 'val') AS n_val, round(avg(Outcome) FILTER (WHERE s.split = 'train'), 10) AS train_pos_rate,
  round(avg(Outcome) FILTER (WHERE s.split = 'val'), 10) AS val_pos_rate
FROM feat f JOIN split s ON f.EncMonth = s.EncMonth GROUP BY 1""",
        ),
        "cluster_means_fixed": with_(_unrounded(_FEATURES), select=profile),
        "cluster_coverage": with_(
            _SCORES,
            select="""SELECT CAST(patientID % 4 AS INTEGER) AS cluster, count(*) AS n, count(*) FILTER (WHERE patientID % 2 = 0) AS covered,
  round(avg(p_rf) FILTER (WHERE patientID % 2 = 0), 10) AS mean FROM sc GROUP BY 1""",
        ),
        "holdout_fixed": with_(
            _SCORES, parts, metric_ctes("parts", "part"),
            select="""SELECT g AS subgroup, n, events, round(prevalence, 10) AS event_rate, auroc, auprc, brier, mean_score, 'ok' AS status FROM rec""",
        ),
        "top_features_fixed": with_(
            _SCORES, _IMPORTANCE, select=f"SELECT model, CAST(place AS INTEGER) AS place, {_NAMES} AS feature, importance FROM best"
        ),
        "insight_drivers": with_(
            _SCORES, _LONG, _IMPORTANCE,
            select=f"""SELECT id, drivers FROM dc, (
  SELECT string_agg({_NAMES} || ' (' || CAST(floor(importance * 100 + 0.5) AS INTEGER) || '%)', '; ' ORDER BY place) AS drivers
  FROM best WHERE model = 'rf' AND feature <> 'N/A')""",
        ),
        "linear_attribution_fixed": with_(_SCORES, select=slopes),
    }


def source_oracles() -> dict[str, str]:
    pct = lambda v: f"CAST(floor({v} * 100 + 0.5) AS INTEGER) || '%'"
    way = "CASE WHEN v IS NULL OR n < 2 THEN 'limited' WHEN v[n] > v[1] THEN 'worsening' WHEN v[n] < v[1] THEN 'improving' ELSE 'flat' END"
    shown = ", ".join(
        f"round(CASE WHEN n >= 6 THEN v[n - {5 - i}] WHEN {i} < 6 - n THEN coalesce(v[1], 0.05) * {i} / 6 ELSE v[{i + 1} - (6 - n)] END, 4) AS t{i + 1}"
        for i in range(6)
    )
    return {
        "view_rows": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
        "table_columns": """SELECT CAST(row_number() OVER () AS INTEGER) AS position, column_name AS col_name FROM (DESCRIBE lineitem)""",
        "missing_columns": "SELECT column_name AS col_name FROM (DESCRIBE lineitem) EXCEPT SELECT column_name FROM (DESCRIBE orders)",
        "document_files": with_(
            _SCORES, _LONG,
            select="SELECT id, model, model = 'rf' AS is_default, population, risk_score, 6 AS points FROM cfg JOIN burden USING (subgroup) JOIN cm USING (subgroup)",
        ),
        "trend_labels": f"""WITH made AS (
  SELECT c_custkey, c_custkey % 8 AS n, list_transform(range(1, c_custkey % 8 + 1), lambda i: CAST((c_custkey * 31 + i * i * 17) % 100 AS DOUBLE) / 128) AS v FROM customer
), named AS (SELECT *, {way} AS direction, {pct("v[1]")} AS p1, {pct("v[n]")} AS pn FROM made)
SELECT c_custkey, {shown}, direction,
  CASE direction WHEN 'limited' THEN 'limited trend data' WHEN 'flat' THEN 'flat at ' || pn ELSE direction || ' from ' || p1 || ' to ' || pn END AS phrase,
  CASE WHEN direction = 'limited' THEN 'Pulse shows cohort activity; trend data is limited.'
    ELSE 'Pulse shows trend direction: ' || CASE WHEN direction = 'worsening' THEN 'worsening' ELSE 'stable or improving' END
      || ' from ' || p1 || ' to ' || pn || '.' END AS pulse,
  CASE WHEN n <= 1 THEN '+12m' ELSE 'now,' || array_to_string(list_transform(range(1, n), lambda i: '+' || CAST(floor(CAST(i AS DOUBLE) / (n - 1) * 12 + 0.5) AS INTEGER) || 'm'), ',') END AS timeline,
  CASE WHEN v[1] > 0 THEN CAST(floor(1 / v[1] + 0.5) AS BIGINT) END AS one_in
FROM named""",
        "text_seeds": """SELECT c_custkey, CAST(list_sum(list_transform(string_split(c_mktsegment, ''), lambda c: unicode(c))) AS INTEGER) AS seed,
  format('{:,}', c_custkey * 1000) AS shown FROM customer""",
        "feature_labels": with_(_SCORES, _IMPORTANCE, select=f"SELECT model, feature, round(importance, 10) AS importance, {_NAMES} AS label FROM importance"),
    }


def all_oracles() -> dict[str, str]:
    return (
        profile_oracles() | score_oracles() | matrix_oracles() | export_oracles() | recurring_oracles() | fixed_oracles() | source_oracles()
    )
