"""Queries on scored rows, on the feature preparation and on users."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from buywave.functions import audience as rules
from buywave.functions import features as fx
from buywave.models import purchase
from buywave.operators import audience as ops
from buywave.operators import calibration, metrics, prep
from buywave.operators.events import fit_vocabulary
from buywave.operators.ordering import running_totals_with_next
from buywave.plans.audience import audience
from buywave.plans.snapshots import daily_snapshot, training_snapshots
from buywave.session import ensure_checkpoint_dir
from buywave.sources.users import cast_to_string, user_ids
from query_catalog import fixtures as fixture
from query_catalog.event_queries import loaded
from query_catalog.fixtures import AUDIENCE_SQL, EVENTS_SQL, FEATURES_SQL, SCORES_SQL, USERS_SQL
from query_catalog.registry import query, with_views

# --- metrics -----------------------------------------------------------------------------------

CUMULATIVE_SQL = (
    SCORES_SQL
    + """,
by_score AS (
  SELECT purchase_proba AS score, COUNT(*) FILTER (WHERE will_purchase_next_7d = 1) AS pos,
         COUNT(*) FILTER (WHERE will_purchase_next_7d = 0) AS neg FROM fx_scores GROUP BY 1),
totals AS (SELECT SUM(pos) AS p, SUM(neg) AS n FROM by_score),
cumulative AS (
  SELECT score, pos, neg, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp FROM by_score)"""
)
AUC_SQL = "(SELECT SUM(c.pos * (t.n - c.fp + c.neg / 2.0)) / (MAX(t.p) * CAST(MAX(t.n) AS DOUBLE)) FROM cumulative c, totals t)"
AP_SQL = "(SELECT SUM(c.pos * c.tp / CAST(c.tp + c.fp AS DOUBLE)) / MAX(t.p) FROM cumulative c, totals t)"
F1_SQL = """(SELECT 2.0 * COUNT(*) FILTER (WHERE will_purchase_next_7d = 1 AND purchase_proba >= 0.5)
             / (COUNT(*) FILTER (WHERE will_purchase_next_7d = 1) + COUNT(*) FILTER (WHERE purchase_proba >= 0.5)) FROM fx_scores)"""
ERRORS_SQL = {
    "mae_days": "(SELECT AVG(ABS(days_to_next_purchase - days_to_next_pred)) FROM fx_scores)",
    "rmse_days": "(SELECT SQRT(AVG(POWER(days_to_next_purchase - days_to_next_pred, 2))) FROM fx_scores)",
    "mae_amount": "(SELECT AVG(ABS(next_purchase_amount - next_purchase_amount_pred)) FROM fx_scores WHERE will_purchase_next_7d = 1)",
    "rmse_amount": "(SELECT SQRT(AVG(POWER(next_purchase_amount - next_purchase_amount_pred, 2))) FROM fx_scores WHERE will_purchase_next_7d = 1)",
}
MEAN_SQL = "(SELECT AVG(purchase_proba) FROM fx_scores)"


@query("metric_auc", with_views(CUMULATIVE_SQL, f"SELECT ROUND({AUC_SQL}, 6) AS auc, ROUND({MEAN_SQL}, 6) AS avg_proba"))
def metric_auc(spark, sf_dir):
    return metrics.metric_auc(fixture.scores(spark, sf_dir))


@query("metric_ap", with_views(CUMULATIVE_SQL, f"SELECT ROUND({AP_SQL}, 6) AS average_precision"))
def metric_ap(spark, sf_dir):
    return metrics.metric_ap(fixture.scores(spark, sf_dir))


@query("metric_f1", with_views(SCORES_SQL, f"SELECT ROUND({F1_SQL}, 6) AS f1"))
def metric_f1(spark, sf_dir):
    return metrics.metric_f1(fixture.scores(spark, sf_dir), threshold=0.5)


@query(
    "metric_regression",
    with_views(SCORES_SQL, "SELECT " + ", ".join(f"ROUND({e}, 6) AS {n}" for n, e in ERRORS_SQL.items())),
)
def metric_regression(spark, sf_dir):
    return metrics.metric_regression(fixture.scores(spark, sf_dir))


@query(
    "evaluate_scores",
    with_views(
        CUMULATIVE_SQL,
        " UNION ALL ".join(
            f"SELECT '{name}' AS metric, ROUND({value}, 6) AS value"
            for name, value in {
                "roc_auc": AUC_SQL, "pr_auc": AP_SQL, "f1": F1_SQL, **ERRORS_SQL, "avg_proba": MEAN_SQL
            }.items()
        ),
    ),
)
def evaluate_scores(spark, sf_dir):
    rows = fixture.scores(spark, sf_dir)
    return metrics.evaluate_scores(rows.withColumn("will_purchase_pred", fx.predicted_class("purchase_proba", 0.5)))


@query(
    "roc_curve",
    with_views(
        CUMULATIVE_SQL,
        """SELECT ROUND(score, 6) AS threshold, ROUND(fp / CAST(t.n AS DOUBLE), 6) AS fpr, ROUND(tp / CAST(t.p AS DOUBLE), 6) AS tpr
           FROM (SELECT *, LEAD(pos) OVER w AS next_pos, LEAD(neg) OVER w AS next_neg, ROW_NUMBER() OVER w AS i
                 FROM cumulative WINDOW w AS (ORDER BY score DESC)) c, totals t
           WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
           UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""",
    ),
)
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(fixture.scores(spark, sf_dir))


@query(
    "pr_curve",
    with_views(
        CUMULATIVE_SQL,
        """SELECT ROUND(score, 6) AS threshold, ROUND(tp / CAST(tp + fp AS DOUBLE), 6) AS "precision",
                  ROUND(tp / CAST(t.p AS DOUBLE), 6) AS recall FROM cumulative, totals t
           UNION ALL SELECT NULL, 1.0, 0.0""",
    ),
)
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(fixture.scores(spark, sf_dir))


@query(
    "best_threshold",
    with_views(
        CUMULATIVE_SQL
        + """,
f1_points AS (
  SELECT score, 2 * pr * re / (pr + re + 1e-10) AS f1
  FROM (SELECT score, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(t.p AS DOUBLE) AS re FROM cumulative, totals t) x)""",
        "SELECT ROUND(LEAST(score, 0.6), 6) AS threshold, ROUND(f1, 6) AS best_f1 FROM f1_points ORDER BY f1 DESC, score LIMIT 1",
    ),
)
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(fixture.scores(spark, sf_dir))


@query(
    "score_histogram",
    with_views(
        SCORES_SQL
        + """,
span AS (SELECT MIN(purchase_proba) AS low, (MAX(purchase_proba) - MIN(purchase_proba)) / 30 AS width FROM fx_scores),
bins AS (SELECT CAST(UNNEST(generate_series(1, 30)) AS INT) AS bin),
filled AS (SELECT bin, COUNT(*) AS n FROM fx_scores, span, bins
           WHERE (bin = 1 OR purchase_proba >= low + width * (bin - 1)) AND (bin = 30 OR purchase_proba < low + width * bin) GROUP BY 1)""",
        """SELECT b.bin, ROUND(low + width * (b.bin - 1), 6) AS low, ROUND(low + width * b.bin, 6) AS high, COALESCE(f.n, 0) AS n
           FROM bins b CROSS JOIN span LEFT JOIN filled f ON f.bin = b.bin""",
    ),
)
def score_histogram(spark, sf_dir):
    return metrics.score_histogram(fixture.scores(spark, sf_dir))


@query(
    "class_weights",
    with_views(
        SCORES_SQL,
        """SELECT will_purchase_next_7d AS label, COUNT(*) AS n,
                  ROUND((SELECT COUNT(*) FROM fx_scores) / ((SELECT COUNT(DISTINCT will_purchase_next_7d) FROM fx_scores) * CAST(COUNT(*) AS DOUBLE)), 6) AS weight
           FROM fx_scores GROUP BY 1""",
    ),
)
def class_weights(spark, sf_dir):
    return metrics.class_weights(fixture.scores(spark, sf_dir))


@query(
    "pinball_loss",
    with_views(
        SCORES_SQL
        + """,
spread AS (SELECT next_purchase_amount AS y, next_purchase_amount_pred * 0.5 AS a, next_purchase_amount_pred AS b,
                  next_purchase_amount_pred * 1.5 AS c FROM fx_scores)""",
        """SELECT ROUND(AVG(GREATEST(-0.95 * (y - a), 0.05 * (y - a)) + GREATEST(-0.5 * (y - b), 0.5 * (y - b))
                        + GREATEST(-0.05 * (y - c), 0.95 * (y - c))), 4) AS pinball_loss FROM spread""",
    ),
)
def pinball_loss(spark, sf_dir):
    base = F.col("next_purchase_amount_pred")
    rows = fixture.scores(spark, sf_dir).select("next_purchase_amount", (base * 0.5).alias("low"), base.alias("mid"), (base * 1.5).alias("high"))
    loss = metrics.pinball_loss(rows, "next_purchase_amount", ["low", "mid", "high"])
    # A mean of large amounts: four digits are what a double sum keeps.
    return loss.select(F.round("pinball_loss", 4).alias("pinball_loss"))


MOMENTS_SQL = (
    SCORES_SQL
    + """,
moments AS (
  SELECT AVG(purchase_proba) FILTER (WHERE will_purchase_next_7d = 1) AS m,
         VAR_POP(purchase_proba) FILTER (WHERE will_purchase_next_7d = 1) AS v
  FROM fx_scores WHERE purchase_proba > 0 AND purchase_proba < 1),
beta AS (
  SELECT GREATEST(m * (m * (1 - m) / v - 1), 0.1) AS alpha, GREATEST((1 - m) * (m * (1 - m) / v - 1), 0.1) AS beta FROM moments)"""
)


@query("beta_moments", with_views(MOMENTS_SQL, "SELECT ROUND(alpha, 6) AS alpha, ROUND(beta, 6) AS beta FROM beta"))
def beta_moments(spark, sf_dir):
    return calibration.beta_moments(fixture.scores(spark, sf_dir), "will_purchase_next_7d", "purchase_proba")


@query(
    "calibrate",
    with_views(
        MOMENTS_SQL,
        """SELECT row_id, ROUND(GREATEST(1e-10, LEAST(1 - 1e-10, (p * alpha + 1 - p) / ((p * alpha + 1 - p) + (p * beta + 1 - p)))), 6) AS calibrated
           FROM (SELECT row_id, purchase_proba AS p FROM fx_scores) s, beta""",
    ),
)
def calibrate(spark, sf_dir):
    rows = fixture.scores(spark, sf_dir)
    return calibration.calibrate_scores(rows, "will_purchase_next_7d", "purchase_proba").select("row_id", "calibrated")


@query(
    "clip_predictions",
    with_views(
        SCORES_SQL,
        """SELECT row_id, CASE WHEN purchase_proba >= 0.5 THEN 1 ELSE 0 END AS will_purchase_pred,
                  GREATEST(0.1, LEAST(30.0, days_to_next_pred)) AS days_to_next_pred,
                  ROUND(GREATEST(10.0, next_purchase_amount_pred), 6) AS next_purchase_amount_pred,
                  CAST(GREATEST(0, LEAST(30, days_to_next_purchase)) AS DOUBLE) AS days_target,
                  CAST(CASE WHEN days_to_next_purchase = 999 THEN 0 ELSE days_to_next_purchase END AS DOUBLE) AS shown_days
           FROM fx_scores""",
    ),
)
def clip_predictions(spark, sf_dir):
    return fixture.scores(spark, sf_dir).select(
        "row_id",
        fx.predicted_class("purchase_proba", 0.5).alias("will_purchase_pred"),
        fx.clip_days("days_to_next_pred").alias("days_to_next_pred"),
        fx.clip_amount("next_purchase_amount_pred").alias("next_purchase_amount_pred"),
        fx.days_target("days_to_next_purchase").alias("days_target"),
        fx.display_days("days_to_next_purchase").alias("shown_days"),
    )


# --- audience ------------------------------------------------------------------------------------

SEGMENT_SQL = """
segments AS (
  SELECT *, CASE WHEN p >= 0.7 AND idle <= 30 THEN 'hot' WHEN p >= 0.3 AND (e7 >= 3 OR idle <= 14) THEN 'warm'
                 WHEN p >= 0.1 THEN 'cold' WHEN w = 0 THEN 'ignore' ELSE 'cold' END AS segment
  FROM (SELECT user_id, COALESCE(purchase_proba, 0) AS p, COALESCE(will_purchase_pred, 0) AS w,
               COALESCE(events_last_7d, 0) AS e7, COALESCE(days_since_last, 999) AS idle,
               COALESCE(events_last_30d, 0) AS e30 FROM fx_audience) a)"""


@query(
    "audience_segment",
    with_views(
        AUDIENCE_SQL + "," + SEGMENT_SQL,
        """SELECT user_id, segment, CASE segment WHEN 'hot' THEN 'Hot Audience' WHEN 'warm' THEN 'Promising'
                  WHEN 'cold' THEN 'Weak Interest' ELSE 'Non-target now' END AS segment_label FROM segments""",
    ),
)
def audience_segment(spark, sf_dir):
    return ops.segment_users(fixture.audience_rows(spark, sf_dir)).select("user_id", "segment", "segment_label")


@query(
    "segment_reason",
    with_views(
        AUDIENCE_SQL + "," + SEGMENT_SQL,
        """SELECT user_id, CONCAT('Chance of purchase ', CASE segment
                  WHEN 'hot' THEN CONCAT(printf('%.0f%%', p * 100), '; last active ', CAST(idle AS VARCHAR), ' days ago; events in 7 days: ', CAST(e7 AS VARCHAR))
                  WHEN 'warm' THEN CONCAT(printf('%.0f%%', p * 100), '; recently active')
                  WHEN 'cold' THEN CONCAT(printf('%.0f%%', p * 100), CASE WHEN p >= 0.1 THEN '; weak signals' ELSE '' END)
                  ELSE CONCAT(printf('%.1f%%', p * 100), '; very low') END) AS segment_reason FROM segments""",
    ),
)
def segment_reason(spark, sf_dir):
    return ops.segment_users(fixture.audience_rows(spark, sf_dir)).select("user_id", "segment_reason")


@query(
    "user_record",
    with_views(AUDIENCE_SQL, "SELECT user_id, ROUND(purchase_proba, 6) AS purchase_proba, events_last_7d FROM fx_audience WHERE user_id = '7-x'"),
)
def user_record(spark, sf_dir):
    rows = fixture.audience_rows(spark, sf_dir).select("user_id", "purchase_proba", "events_last_7d")
    return ops.user_record(rows, "7-x")


@query(
    "prediction_series",
    with_views(
        AUDIENCE_SQL,
        """SELECT user_id, ROUND(purchase_proba, 6) AS purchase_proba, events_last_7d, days_since_last AS will_purchase_pred
           FROM fx_audience""",
    ),
)
def prediction_series(spark, sf_dir):
    """A numeric input overrides an output of its name; text inputs are no series."""
    log = fixture.audience_rows(spark, sf_dir).select(
        "user_id",
        F.struct("purchase_proba", "will_purchase_pred").alias("output"),
        F.struct("events_last_7d", F.col("days_since_last").alias("will_purchase_pred"), F.col("user_id").alias("note")).alias("input"),
    )
    return ops.prediction_series(log)


@query(
    "activity_share",
    with_views(
        AUDIENCE_SQL + "," + SEGMENT_SQL,
        """SELECT user_id, CASE WHEN e30 > 0 THEN ROUND(LEAST(100.0, e7 / CAST(e30 AS DOUBLE) * 100), 6) ELSE 0.0 END AS activity_share
           FROM segments""",
    ),
)
def activity_share(spark, sf_dir):
    return fixture.audience_rows(spark, sf_dir).select("user_id", rules.activity_share().alias("activity_share"))


@query(
    "rank_users",
    with_views(
        AUDIENCE_SQL,
        """SELECT user_id, ROUND(purchase_proba, 6) AS purchase_proba FROM fx_audience
           ORDER BY fx_audience.purchase_proba DESC NULLS LAST, user_id""",
    ),
)
def rank_users(spark, sf_dir):
    return ops.rank_users(fixture.audience_rows(spark, sf_dir).select("user_id", "purchase_proba"))


@query(
    "user_search",
    with_views(
        AUDIENCE_SQL,
        """SELECT user_id, split_part(user_id, '-', 1) AS short_id FROM fx_audience
           WHERE contains(lower(user_id), '12')""",
    ),
)
def user_search(spark, sf_dir):
    found = ops.search_users(fixture.audience_rows(spark, sf_dir), "  12 ")
    return found.select("user_id", rules.short_id().alias("short_id"))


@query("user_ids", with_views(USERS_SQL, "SELECT user_uid FROM fx_users ORDER BY user_uid"))
def ids(spark, sf_dir):
    return user_ids(fixture.users(spark, sf_dir))


@query("users_cast", with_views(USERS_SQL, "SELECT id, user_uid, region FROM fx_users"))
def users_cast(spark, sf_dir):
    return cast_to_string(fixture.users(spark, sf_dir), ["user_uid", "absent"])


@query(
    "users_features",
    with_views(
        EVENTS_SQL + "," + USERS_SQL,
        """SELECT u.user_uid AS user_id, a.total_events, a.total_purchases, a.last_date
           FROM fx_users u LEFT JOIN (
             SELECT user_id, COUNT(*) AS total_events, COUNT(*) FILTER (WHERE event_type = 'purchase') AS total_purchases,
                    (SELECT MAX(date) FROM ev) AS last_date FROM ev GROUP BY user_id) a ON a.user_id = u.user_uid""",
    ),
)
def users_features(spark, sf_dir):
    snapshot = daily_snapshot(loaded(spark, sf_dir), vocabulary=[])
    slim = snapshot.select("user_id", "total_events", "total_purchases", F.col("snapshot_date").alias("last_date"))
    return ops.users_features(fixture.users(spark, sf_dir), slim)


@query(
    "recent_predictions",
    with_views(
        EVENTS_SQL,
        """SELECT user_id, event_id, ts, rn FROM (
             SELECT user_id, event_id, ts, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS rn
             FROM fx_events) r WHERE rn <= 20""",
    ),
)
def recent_predictions(spark, sf_dir):
    log = fixture.events(spark, sf_dir).select("user_id", "event_id", "ts")
    return ops.recent_predictions(log)


@query(
    "prediction_stats",
    with_views(
        EVENTS_SQL,
        """SELECT CASE WHEN event_type = 'error' THEN 'Manual Input' ELSE user_id END AS "user", COUNT(*) AS predictions,
                  MAX(ts) AS last_prediction FROM fx_events GROUP BY 1""",
    ),
)
def prediction_stats(spark, sf_dir):
    # Error events stand for predictions without a user.
    log = fixture.events(spark, sf_dir).select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"), "ts")
    return ops.prediction_stats(log)


# --- preparation -----------------------------------------------------------------------------------

FEATURE_NAMES = ["total_spent", "absent_number", "seq_emb_0", "last_event_type"]


@query(
    "align_columns",
    with_views(
        FEATURES_SQL,
        "SELECT user_id, ROUND(total_spent, 6) AS total_spent, 0 AS absent_number, seq_emb_0, last_event_type FROM fx_score_rows",
    ),
)
def align_columns(spark, sf_dir):
    return prep.align_columns(fixture.features_to_score(spark, sf_dir), FEATURE_NAMES, keep=["user_id"])


@query(
    "impute_median",
    with_views(
        FEATURES_SQL,
        """SELECT user_id, ROUND(COALESCE(total_spent, (SELECT quantile_cont(total_spent, 0.5) FROM fx_features)), 6) AS total_spent,
                  micro_event_growth FROM fx_score_rows""",
    ),
)
def impute_median(spark, sf_dir):
    medians = prep.fit_medians(fixture.features(spark, sf_dir), ["total_spent", "micro_event_growth"])
    return prep.impute(fixture.features_to_score(spark, sf_dir), medians).select("user_id", *medians)


@query(
    "iqr_clip",
    with_views(
        FEATURES_SQL
        + """,
filled AS (SELECT user_id, COALESCE(total_spent, (SELECT quantile_cont(total_spent, 0.5) FROM fx_features)) AS x FROM fx_features),
quartiles AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM filled)""",
        "SELECT user_id, ROUND(GREATEST(a - 3 * (b - a), LEAST(b + 3 * (b - a), x)), 6) AS total_spent FROM filled, quartiles",
    ),
)
def iqr_clip(spark, sf_dir):
    rows = fixture.features(spark, sf_dir)
    filled = prep.impute(rows, prep.fit_medians(rows, ["total_spent"]))
    return prep.clip_outliers(filled, prep.iqr_bounds(filled, ["total_spent"])).select("user_id", "total_spent")


@query(
    "seq_standardize",
    with_views(
        FEATURES_SQL,
        """SELECT user_id, ROUND((seq_emb_0 - (SELECT AVG(seq_emb_0) FROM fx_features)) / (SELECT STDDEV_POP(seq_emb_0) FROM fx_features), 6) AS seq_emb_0,
                  ROUND(seq_emb_1 - (SELECT AVG(seq_emb_1) FROM fx_features), 6) AS seq_emb_1 FROM fx_score_rows""",
    ),
)
def seq_standardize(spark, sf_dir):
    scaler = prep.fit_scaler(fixture.features(spark, sf_dir), ["seq_emb_0", "seq_emb_1"])
    return prep.apply_scaler(fixture.features_to_score(spark, sf_dir), scaler).select("user_id", *scaler)


@query(
    "label_encode",
    with_views(
        FEATURES_SQL
        + """,
codes AS (SELECT value, CAST(ROW_NUMBER() OVER (ORDER BY value) - 1 AS INT) AS code
          FROM (SELECT DISTINCT COALESCE(last_event_type, '__MISSING__') AS value FROM fx_features) v)""",
        """SELECT r.user_id, COALESCE(c.code, -1) AS last_event_type FROM fx_score_rows r
           LEFT JOIN codes c ON c.value = COALESCE(r.last_event_type, '__MISSING__')""",
    ),
)
def label_encode(spark, sf_dir):
    codes = prep.fit_label_codes(fixture.features(spark, sf_dir), ["last_event_type"])
    return prep.encode_labels(fixture.features_to_score(spark, sf_dir), codes, "last_event_type").select("user_id", "last_event_type")


NUMBERS = ["total_spent", "micro_event_growth", "seq_emb_0", "seq_emb_1"]
PREPARED_SQL = FEATURES_SQL + f""",
filled AS (
  SELECT user_id, COALESCE(last_event_type, '__MISSING__') AS last_event_type,
         {", ".join(f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM fx_features)) AS {c}" for c in NUMBERS)} FROM fx_features),
quartiles AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in NUMBERS)} FROM filled),
clipped AS (
  SELECT user_id, last_event_type,
         {", ".join(f"GREATEST(a_{c} - 3 * (b_{c} - a_{c}), LEAST(b_{c} + 3 * (b_{c} - a_{c}), {c})) AS {c}" for c in NUMBERS)}
  FROM filled, quartiles),
codes AS (SELECT last_event_type, ROW_NUMBER() OVER (ORDER BY last_event_type) - 1 AS code FROM (SELECT DISTINCT last_event_type FROM filled) v)"""
SCALED_SQL = ", ".join(
    f"ROUND(({c} - (SELECT AVG({c}) FROM clipped)) / COALESCE(NULLIF((SELECT STDDEV_POP({c}) FROM clipped), 0), 1), 6) AS x_{c}" for c in NUMBERS[2:]
)


@query(
    "prepare_features",
    with_views(
        PREPARED_SQL,
        f"""SELECT user_id, ROUND(total_spent, 6) AS x_total_spent, micro_event_growth AS x_micro_event_growth, {SCALED_SQL},
                   CAST(code AS DOUBLE) AS x_last_event_type FROM clipped JOIN codes USING (last_event_type)""",
    ),
)
def prepare_features(spark, sf_dir):
    preparation, fitted = prep.fit_preparation(fixture.features(spark, sf_dir))
    return fitted.select("user_id", *preparation.inputs)


@query(
    "default_record",
    with_views(
        FEATURES_SQL,
        f"""SELECT {", ".join(f"ROUND(quantile_cont({c}, 0.5), 6) AS {c}" for c in NUMBERS)}, CAST(0 AS DOUBLE) AS last_event_type
            FROM fx_features""",
    ),
)
def default_record(spark, sf_dir):
    preparation, _ = prep.fit_preparation(fixture.features(spark, sf_dir))
    return preparation.default_record(spark)


@query(
    "detect_columns",
    with_views(
        FEATURES_SQL,
        """SELECT column_name, role FROM (
             SELECT UNNEST(['total_spent', 'micro_event_growth', 'seq_emb_0', 'seq_emb_1']) AS column_name, 'numeric' AS role
             UNION ALL
             SELECT 'last_event_type', CASE WHEN COUNT(DISTINCT last_event_type) BETWEEN 2 AND 200 THEN 'categorical' END FROM fx_features) c
           WHERE role IS NOT NULL""",
    ),
)
def detect_columns(spark, sf_dir):
    return prep.detect_columns(fixture.features(spark, sf_dir))


@query(
    "shape_inputs",
    with_views(
        FEATURES_SQL,
        """SELECT user_id, ROUND(COALESCE(total_spent, 0), 6) AS total_spent, CAST(0 AS DOUBLE) AS absent_number, seq_emb_0,
                  COALESCE(last_event_type, '') AS last_event_type FROM fx_score_rows""",
    ),
)
def shape_inputs(spark, sf_dir):
    return rules.shape_inputs(fixture.features_to_score(spark, sf_dir), FEATURE_NAMES)


@query(
    "invalid_fields",
    """SELECT CAST(c_custkey AS VARCHAR) AS user_id,
              CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 13 = 0 THEN 'total_spent,last_event_type' ELSE 'total_spent' END
                   WHEN c_custkey % 13 = 0 THEN 'last_event_type' ELSE '' END AS invalid
       FROM customer""",
)
def invalid_fields(spark, sf_dir):
    key = F.col("c_custkey")
    records = fixture.table(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.when(key % 7 == 0, "abc").when(key % 10 == 0, "").otherwise(F.col("c_acctbal").cast("string")).alias("total_spent"),
        F.when(key % 13 != 0, F.col("c_mktsegment")).alias("last_event_type"),
    )
    found = rules.invalid_fields(records, ["total_spent", "last_event_type"])
    return records.select("user_id", F.array_join(found, ",").alias("invalid"))


# --- models ----------------------------------------------------------------------------------------

#: Boosting rounds of the ranked audience, whose checks hold for any model.
FEW_ROUNDS = {"maxIter": 10}


def _fitted(spark, sf_dir, **sizes):
    """A model fitted on the training rows, and the daily snapshot with the vocabulary of the model. Both tables
    are materialised once, as stored ones would be: the sums of a snapshot that is built again may differ in
    their last digit, and a split then sends a row the other way."""
    events = loaded(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    vocabulary = fit_vocabulary(events)

    def fitted():
        rows = training_snapshots(events, vocabulary=vocabulary).checkpoint()
        return purchase.fit(rows, vocabulary=vocabulary, **sizes)

    return purchase.side_by_side(
        spark, fitted, lambda: daily_snapshot(events, vocabulary=vocabulary).checkpoint()
    )


# Fitted trees cannot be compared bit by bit: per user, SQL states what must hold for any fit. The values
# themselves are compared with a walk down the stored trees by joins.
SCORED_USERS = """SELECT user_id, COUNT(*) AS total_events, TRUE AS probability_ok, TRUE AS class_ok,
                         TRUE AS days_ok, TRUE AS amount_ok{more} FROM fx_events GROUP BY user_id"""


def _walked(inputs, trees, folder, name):
    """(user_id, ``name``): the weighted sum of the leaves that a user's inputs reach in the stored trees."""
    spark = inputs.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    trees.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    nodes = F.broadcast(  # the trees of one model
        stored.select(
            "tree", F.col("id").alias("node"), "prediction", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
            F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("limit"),
        )
    )
    at = inputs.select("user_id", "x", F.explode(F.sequence(F.lit(0), F.lit(trees.getNumTrees - 1))).alias("tree"))
    at = at.withColumn("node", F.lit(0))
    child = F.when(F.get("x", F.col("feature")) <= F.col("limit"), F.col("left")).otherwise(F.col("right"))
    for _ in range(trees.getOrDefault("maxDepth")):
        down = F.when(F.col("left") < 0, F.col("node")).otherwise(child)
        at = at.join(nodes, ["tree", "node"]).select("user_id", "x", "tree", down.alias("node"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in trees.treeWeights]), F.col("tree"))
    leaves = at.join(nodes, ["tree", "node"])
    return leaves.groupBy("user_id").agg(F.sum(F.col("prediction") * weight).alias(name))


def _checked(model, snapshot, scored):
    """``scored`` with the checks of its predictions against the walk."""
    spark = snapshot.sparkSession
    folder = ensure_checkpoint_dir(spark)
    prepared = purchase.assemble(model.preparation.transform(snapshot), model.preparation.inputs)
    inputs = prepared.select("user_id", vector_to_array(purchase.INPUTS).alias("x")).checkpoint()
    walked = _walked(inputs, model.classifier, folder, "raw")
    for name in ("days", "amount"):
        walked = walked.join(_walked(inputs, getattr(model, name), folder, name), "user_id")
    p = F.col("purchase_proba")

    def same(column, value):
        return F.abs(F.col(column) - value) < 1e-9

    checks = {
        "probability_ok": same("purchase_proba", 1 / (1 + F.exp(-2 * F.col("raw")))),
        "class_ok": F.col("will_purchase_pred") == (p >= F.lit(model.threshold)).cast("int"),
        "days_ok": same("days_to_next_pred", F.least(F.greatest("days", F.lit(0.1)), F.lit(30.0))),
        "amount_ok": same("next_purchase_amount_pred", F.greatest("amount", F.lit(10.0))),
    }
    return scored.join(walked, "user_id").withColumns(checks), list(checks)


@query("score_users", with_views(EVENTS_SQL, SCORED_USERS.format(more="")))
def score_users(spark, sf_dir):
    """The default model: 200 and 150 boosting rounds."""
    model, snapshot = _fitted(spark, sf_dir)
    scored, checks = _checked(model, snapshot, model.score(snapshot))
    return scored.select("user_id", "total_events", *checks)


@query(
    "audience",
    with_views(EVENTS_SQL, SCORED_USERS.format(more=", TRUE AS rank_ok, TRUE AS segment_ok")),
)
def ranked_audience(spark, sf_dir):
    """The ranked rows in their order over all ranges: probabilities must not rise, segments follow the rule."""
    model, snapshot = _fitted(spark, sf_dir, classifier=FEW_ROUNDS, regressor=FEW_ROUNDS)
    # Numbers in the ranked order: partitions of a sort follow each other.
    ranked = audience(snapshot, model).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    lined = ranked.select("at", "purchase_proba", F.lit(1).cast("bigint").alias("one"))
    before = running_totals_with_next(lined, "at", {"place": "one"}, {"before": "purchase_proba"}).select("at", "before")
    again = F.expr(
        """CASE WHEN purchase_proba >= 0.7 AND days_since_last <= 30 THEN 'hot'
                WHEN purchase_proba >= 0.3 AND (events_last_7d >= 3 OR days_since_last <= 14) THEN 'warm'
                WHEN purchase_proba < 0.1 AND will_purchase_pred = 0 THEN 'ignore' ELSE 'cold' END"""
    )
    scored, checks = _checked(model, snapshot, ranked.join(before, "at"))
    more = {
        "rank_ok": F.col("before").isNull() | (F.col("before") >= F.col("purchase_proba")),
        "segment_ok": F.col("segment") == again,
    }
    return scored.withColumns(more).select("user_id", "total_events", *checks, *more)
