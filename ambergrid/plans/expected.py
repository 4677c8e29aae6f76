"""Plain SQL for the registered queries, used to check their results on the same tables."""

from __future__ import annotations


TX = """tx AS (
  SELECT event_id AS tx_id, user_id, ts, value AS amount, event_type AS category,
    CASE event_id % 3 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'debit_card' ELSE 'mobile_payment' END AS channel,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 2 THEN 1 ELSE 0 END AS is_fraud
  FROM events)"""

#: The transactions that the stratified split leaves for testing.
TEST_ROWS = f"""WITH {TX}, h AS (SELECT tx_id,
    row_number() OVER (PARTITION BY is_fraud ORDER BY substr(md5(tx_id || '42'), 1, 15)) AS rn,
    count(*) OVER (PARTITION BY is_fraud) AS n FROM tx),
  test AS (SELECT tx_id FROM h WHERE rn <= round(n * 0.2::DOUBLE))"""

RUNS = """runs AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, 'p' || (user_id % 3) AS pipeline, event_type AS step,
    (event_type <> 'error' OR value < 50) AS success,
    CASE WHEN NOT (event_type <> 'error' OR value < 50) THEN 'step ' || event_type || ' failed' END AS error,
    ts AS start_ts, value * 1000 AS duration_ms,
    CASE event_type WHEN 'purchase' THEN 2048 WHEN 'signup' THEN 1024 ELSE 512 END AS memory_mb,
    event_type = 'purchase' AS gpu, event_id AS seq
  FROM events)"""

STATS = """stats AS (
  SELECT user_id, avg(amount) AS user_avg_amount, stddev_samp(amount) AS user_std_amount,
    count(amount) AS user_amount_count, count(tx_id) AS user_transaction_count
  FROM tx GROUP BY user_id)"""

GAPS = """gaps AS (
  SELECT tx_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, tx_id), ts) / 1e6::DOUBLE AS gap
  FROM tx)"""

FEATURES = f"""{TX}, {STATS}, {GAPS},
q AS (SELECT quantile_cont(amount, 0.95) AS q95 FROM tx),
base AS (
  SELECT tx.*, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
    CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN hour(ts) >= 22 OR hour(ts) <= 6 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS risky_hour_flag,
    ln(1 + amount) AS amount_log,
    user_avg_amount, user_std_amount, user_transaction_count,
    (amount - user_avg_amount) / (user_std_amount + 1e-5::DOUBLE) AS amount_zscore,
    gap AS time_since_last_transaction,
    CASE WHEN gap < 60 THEN 1 ELSE 0 END AS velocity_flag,
    CASE category WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2
      WHEN 'click' THEN 1 WHEN 'view' THEN 1 END AS merchant_risk_score,
    CASE WHEN amount > q95 THEN 1 ELSE 0 END AS high_amount_flag,
    CASE WHEN amount < 1 THEN 1 ELSE 0 END AS micro_transaction_flag
  FROM tx LEFT JOIN stats USING (user_id) JOIN gaps USING (tx_id) CROSS JOIN q),
feats AS (
  SELECT *, velocity_flag * 2 + high_amount_flag * 3 + micro_transaction_flag + risky_hour_flag
    + merchant_risk_score
    + CASE WHEN amount_zscore IS NOT NULL THEN least(greatest(amount_zscore, 0.0::DOUBLE), 5.0::DOUBLE) END AS risk_score
  FROM base)"""


def _scores(table: str) -> str:
    return f"""raw_scores AS (
  SELECT *, (tx_id % 100) / 100.0::DOUBLE AS isolation_score, (tx_id * 7 % 101) / 100.0::DOUBLE AS rf_probability
  FROM {table}),
scored AS (
  SELECT *, 0.3::DOUBLE * least(greatest(isolation_score, 0.0::DOUBLE), 1.0::DOUBLE) + 0.7::DOUBLE * rf_probability
    AS fraud_score
  FROM raw_scores)"""


SCORED_TX = f"{TX}, {_scores('tx')}"
SCORED = f"{FEATURES}, {_scores('feats')}"
LEVEL = "CASE WHEN fraud_score > 0.9::DOUBLE THEN 'CRITICAL' WHEN fraud_score > 0.7::DOUBLE THEN 'WARNING' END"

GAPPY = f"""{TX}, gappy AS (
  SELECT tx_id, CASE WHEN tx_id % 7 <> 0 THEN amount END AS amount,
    CASE WHEN tx_id % 5 <> 0 THEN amount * 10 END AS time_since_last,
    CASE WHEN tx_id % 11 <> 0 THEN category END AS category
  FROM tx)"""

ENTRIES = f"""{TX}, entries AS (
  SELECT category || '/' || user_id AS key, tx_id AS run_id, ts AS saved_at, amount < 20 AS deleted FROM tx),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY saved_at DESC, run_id DESC) AS rn FROM entries)
  WHERE rn = 1)"""


# The texts are written out, so that a wrong constant of the library shows.
REASON = """coalesce(nullif(concat_ws(' | ',
    CASE WHEN velocity_flag = 1 THEN 'Transaction trop rapide' END,
    CASE WHEN high_amount_flag = 1 THEN 'Montant anormalement élevé ($' || printf('%.2f', amount) || ')' END,
    CASE WHEN risky_hour_flag = 1 THEN 'Heure suspecte (' || hour || 'h)' END,
    CASE WHEN merchant_risk_score >= 3 THEN 'Merchant à risque (' || category || ')' END,
    CASE WHEN amount_zscore > 3 THEN 'Montant très différent du comportement habituel' END), ''), 'Pattern anormal détecté')"""

ALERT_RULES = """rules(step, limit_ms, on_error) AS (VALUES
  ('click', 10000.0::DOUBLE, true), ('view', 60000.0::DOUBLE, true), ('purchase', 150000.0::DOUBLE, false),
  ('error', 180000.0::DOUBLE, true), ('signup', NULL::DOUBLE, true))"""

_R = "round({0}, 6) AS {0}"
_L = "CAST({0} AS BIGINT) AS {0}"


def _cols(doubles: str = "", longs: str = "", plain: str = "") -> str:
    parts = [c for c in plain.split()]
    parts += [_R.format(c) for c in doubles.split()]
    parts += [_L.format(c) for c in longs.split()]
    return ", ".join(parts)


_FEATURE_DOUBLES = (
    "amount amount_log amount_zscore user_avg_amount user_std_amount time_since_last_transaction risk_score"
)
_FEATURE_LONGS = (
    "hour day_of_week is_weekend is_night user_transaction_count velocity_flag merchant_risk_score "
    "high_amount_flag micro_transaction_flag risky_hour_flag"
)

EXPECTED = {
    "src_parquet": "SELECT * FROM orders",
    "src_csv_inferred": "SELECT * FROM orders",
    "src_csv": "SELECT * FROM orders",
    "load_day": f"WITH {TX} SELECT * FROM tx WHERE ts >= '2024-01-15' AND ts < '2024-01-16'",
    "load_last_hour": f"WITH {TX} SELECT * FROM tx WHERE ts >= '2024-01-15 11:00:00' AND ts < '2024-01-15 12:00:00'",
    "gen_profile": """WITH size AS (SELECT max(event_id) + 1 AS n FROM events),
      sizes AS (SELECT n, CAST(floor(n * 0.02::DOUBLE) AS BIGINT) AS f FROM size),
      ids AS (SELECT event_id, n, f, event_id - (n - f) AS rank FROM events CROSS JOIN sizes)
      SELECT CAST(rank >= 0 AS BIGINT) AS is_fraud, count(*) AS n,
        count(*) FILTER (rank >= 0 AND rank < f // 2) AS n_high_fraud, true AS amounts_ok, true AS ids_ok,
        min(TIMESTAMP '2024-01-15' + to_seconds(CASE WHEN rank >= 0 THEN rank * 30 ELSE event_id * 60 END)) AS first_ts,
        max(TIMESTAMP '2024-01-15' + to_seconds(CASE WHEN rank >= 0 THEN rank * 30 ELSE event_id * 60 END)) AS last_ts
      FROM ids GROUP BY 1""",
    "ds_roundtrip": f"WITH {TX} SELECT tx_id, amount FROM tx",
    "ds_step_result": f"WITH {TX} SELECT tx_id, amount FROM tx",
    "ds_metadata": f"""WITH {TX}
      SELECT 'tx/amounts' AS key, count(*) AS rows, 'risk' AS owner, true AS has_bytes FROM tx
      UNION ALL SELECT 'tx/users', count(DISTINCT user_id), 'risk', true FROM tx""",
    "ds_list": f"WITH {ENTRIES} SELECT key FROM latest WHERE NOT deleted AND starts_with(key, 'p') ORDER BY key",
    "ds_latest": f"WITH {ENTRIES} SELECT key, run_id, saved_at FROM latest",
    "na_drop": f"""WITH {GAPPY} SELECT tx_id, round(amount, 6) AS amount, round(time_since_last, 6) AS time_since_last,
      category FROM gappy WHERE amount IS NOT NULL AND time_since_last IS NOT NULL AND category IS NOT NULL""",
    "na_fill": f"""WITH {GAPPY} SELECT tx_id, round(coalesce(amount, 0), 6) AS amount,
      round(coalesce(time_since_last, 0), 6) AS time_since_last, category FROM gappy""",
    "na_fill_default": f"""WITH {GAPPY} SELECT tx_id, round(coalesce(amount, 0), 6) AS amount,
      round(coalesce(time_since_last, 3600), 6) AS time_since_last, category FROM gappy""",
    "risk_projection": f"WITH {FEATURES} SELECT tx_id, {_cols('risk_score amount_zscore')} FROM feats",
    "drop_col": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
      l_discount, l_tax FROM lineitem""",
    "ratio_features": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
      l_extendedprice / nullif(l_quantity, 0) AS price_per_unit,
      l_tax / nullif(l_discount, 0) AS tax_to_discount FROM lineitem""",
    "align_features": f"""WITH {TX} SELECT tx_id, round(amount, 6) AS amount, CAST(hour(ts) AS BIGINT) AS hour,
      0.0::DOUBLE AS payment_cash, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, 0.0::DOUBLE AS payment_cheque FROM tx""",
    "time_features": f"""WITH {FEATURES} SELECT tx_id,
      {_cols('', 'hour day_of_week is_weekend is_night risky_hour_flag')} FROM feats""",
    "flag_features": f"""WITH {FEATURES} SELECT tx_id,
      {_cols('', 'high_amount_flag micro_transaction_flag risky_hour_flag')} FROM feats""",
    "route_by_threshold": f"""WITH {TX} SELECT CASE WHEN amount > 200 THEN 'review' WHEN amount > 100 THEN 'check'
      WHEN amount > 50 THEN 'log' ELSE 'pass' END AS route, count(*) AS n FROM tx GROUP BY 1""",
    "amount_log": f"WITH {TX} SELECT tx_id, round(ln(1 + amount), 6) AS amount_log FROM tx",
    "clip": f"""WITH {TX} SELECT tx_id, CASE WHEN tx_id % 7 <> 0
      THEN round(least(greatest(amount - 50, 0.0::DOUBLE), 5.0::DOUBLE), 6) END AS clipped FROM tx""",
    "ts_format": f"""WITH {TX} SELECT tx_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, date_trunc('second', ts) AS parsed,
      date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) - INTERVAL 1 HOUR AS hour_before FROM tx""",
    "one_hot": f"""WITH {TX} SELECT tx_id, CAST(channel = 'credit_card' AS BIGINT) AS payment_credit_card,
      CAST(channel = 'debit_card' AS BIGINT) AS payment_debit_card,
      CAST(channel = 'mobile_payment' AS BIGINT) AS payment_mobile_payment FROM tx""",
    "join_user_stats": f"""WITH {TX}, {STATS} SELECT tx_id, user_id, {_cols('user_avg_amount user_std_amount',
      'user_amount_count user_transaction_count')} FROM tx LEFT JOIN stats USING (user_id)""",
    "category_risk": f"""WITH {TX} SELECT tx_id, category, CAST(CASE category WHEN 'error' THEN 4 WHEN 'purchase' THEN 3
      WHEN 'signup' THEN 2 WHEN 'click' THEN 1 END AS BIGINT) AS merchant_risk_score FROM tx""",
    "high_amount": f"WITH {FEATURES} SELECT tx_id, {_cols('', 'high_amount_flag')} FROM feats",
    "score_attach": f"""WITH {SCORED_TX} SELECT tx_id, user_id,
      {_cols('amount isolation_score rf_probability')} FROM scored""",
    "fraud_score": f"""WITH {SCORED_TX} SELECT tx_id, round(fraud_score, 6) AS fraud_score,
      CAST(fraud_score > 0.7::DOUBLE AS BIGINT) AS is_fraudulent FROM scored""",
    "user_stats": f"""WITH {TX}, {STATS} SELECT user_id, {_cols('user_avg_amount user_std_amount',
      'user_amount_count user_transaction_count')} FROM stats""",
    "amount_q95": f"WITH {TX} SELECT round(quantile_cont(amount, 0.95), 6) AS q95 FROM tx",
    "class_counts": f"""WITH {TX} SELECT count(*) AS total, count(*) FILTER (is_fraud = 0) AS normal,
      count(*) FILTER (is_fraud = 1) AS fraud FROM tx""",
    "alert_stats": f"""WITH {SCORED_TX} SELECT count(*) AS total_transactions,
      count(*) FILTER ({LEVEL} = 'CRITICAL') AS critical_alerts, count(*) FILTER ({LEVEL} = 'WARNING') AS warning_alerts,
      count(*) FILTER ({LEVEL} IS NOT NULL) AS total_flagged,
      round(coalesce(sum(amount) FILTER ({LEVEL} IS NOT NULL), 0), 6) AS flagged_amount FROM scored""",
    "audit_report": f"""WITH {SCORED_TX} SELECT '2024-01-15 12:30:00' AS timestamp, count(*) AS total_transactions,
      count(*) FILTER ({LEVEL} IS NOT NULL) AS fraudulent_transactions,
      round(count(*) FILTER ({LEVEL} IS NOT NULL) / count(*)::DOUBLE, 6) AS fraud_rate,
      round(sum(amount), 6) AS total_amount,
      round(coalesce(sum(amount) FILTER ({LEVEL} IS NOT NULL), 0), 6) AS fraudulent_amount,
      count(*) FILTER ({LEVEL} = 'CRITICAL') AS critical_alerts, count(*) FILTER ({LEVEL} = 'WARNING') AS warning_alerts,
      round(avg(fraud_score), 6) AS avg_fraud_score, round(max(fraud_score), 6) AS max_fraud_score FROM scored""",
    "eval_accuracy": "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM labels",
    "eval_report": """WITH classes AS (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels),
      counts AS (SELECT c, (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS hits,
        (SELECT count(*) FROM labels WHERE quality = c) AS support,
        (SELECT count(*) FROM labels WHERE toxic = c) AS predicted FROM classes),
      pr AS (SELECT *, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS precision,
        coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall FROM counts),
      f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr),
      report AS (
        SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM f
        UNION ALL SELECT 'accuracy', sum(hits) / sum(support)::DOUBLE, sum(hits) / sum(support)::DOUBLE,
          sum(hits) / sum(support)::DOUBLE, sum(support) FROM f
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1 * support) / sum(support), sum(support) FROM f)
      SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
        CAST(support AS BIGINT) AS support FROM report""",
    "eval_auc": f"""WITH {TX}, s AS (SELECT amount, count(*) FILTER (is_fraud = 1) AS pos,
        count(*) FILTER (is_fraud = 0) AS neg FROM tx GROUP BY amount),
      r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY amount) - neg AS below FROM s)
      SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM r""",
    "time_since_last": f"""WITH {TX}, {GAPS} SELECT tx_id, round(gap, 6) AS time_since_last_transaction FROM gaps""",
    "velocity_flag": f"""WITH {TX}, {GAPS} SELECT tx_id, CAST(coalesce(gap < 60, false) AS BIGINT) AS velocity_flag
      FROM gaps""",
    "amount_zscore": f"""WITH {TX}, {STATS} SELECT tx_id,
      round((amount - user_avg_amount) / (user_std_amount + 1e-5::DOUBLE), 6) AS amount_zscore
      FROM tx LEFT JOIN stats USING (user_id)""",
    "risk_score": f"WITH {FEATURES} SELECT tx_id, round(risk_score, 6) AS risk_score FROM feats",
    "fraud_features": f"""WITH {FEATURES} SELECT tx_id, user_id, {_cols(_FEATURE_DOUBLES, _FEATURE_LONGS)} FROM feats""",
    "sort_user_ts": f"WITH {TX} SELECT user_id, ts, tx_id FROM tx ORDER BY user_id, ts, tx_id",
    "topk": f"""WITH {TX} SELECT tx_id, category, round(amount, 6) AS amount FROM tx
      ORDER BY tx.amount DESC, tx_id LIMIT 10""",
    "shuffle_order": f"""WITH {TX} SELECT tx_id,
      row_number() OVER (ORDER BY substr(md5(tx_id || '42'), 1, 15), tx_id) AS position FROM tx""",
    "log_tail": f"""WITH {RUNS} SELECT seq, run_id, pipeline, step, start_ts, success FROM runs
      WHERE pipeline = 'p1' AND step = 'error' AND start_ts >= '2024-01-20' ORDER BY start_ts DESC, seq DESC LIMIT 100""",
    "union_by_name": f"""WITH {TX} SELECT tx_id, round(amount, 6) AS amount, 'high' AS extra FROM tx WHERE amount > 100
      UNION ALL SELECT tx_id, round(amount, 6), NULL FROM tx WHERE amount < 120""",
    "alerts": f"""WITH {SCORED} SELECT {LEVEL} AS level, tx_id, user_id, round(amount, 6) AS amount,
      round(fraud_score, 6) AS fraud_score, ts FROM scored WHERE {LEVEL} IS NOT NULL""",
    "alert_tiers": f"""WITH {SCORED_TX} SELECT tx_id, user_id, {_cols('amount fraud_score')} FROM scored
      WHERE {LEVEL} = 'WARNING'""",
    "alert_reasons": f"""WITH {SCORED} SELECT tx_id, {LEVEL} AS level, {REASON} AS reason FROM scored
      WHERE {LEVEL} IS NOT NULL""",
    "alert_sink": f"""WITH {SCORED_TX} SELECT {LEVEL} AS level, count(*) AS n,
      (SELECT count(*) > 0 FROM scored WHERE fraud_score > 0.9::DOUBLE) AS notify
      FROM scored WHERE {LEVEL} IS NOT NULL GROUP BY 1""",
    "metrics_long": f"""WITH {RUNS}, s AS (SELECT step, count(*)::DOUBLE AS runs,
        count(*) FILTER (success)::DOUBLE AS successes, avg(success::INT)::DOUBLE AS success_rate FROM runs GROUP BY step),
      m AS (SELECT step, 'runs' AS metric, runs AS value FROM s UNION ALL SELECT step, 'successes', successes FROM s
        UNION ALL SELECT step, 'success_rate', success_rate FROM s)
      SELECT step, metric, round(value, 6) AS value, 'Count' AS unit, 'prod' AS stage FROM m""",
    "log_json": """SELECT ts AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
      'event ' || event_type AS message, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "split_random": f"""WITH {TX}, h AS (SELECT tx_id, row_number() OVER (ORDER BY substr(md5(tx_id || '42'), 1, 15)) AS rn,
        count(*) OVER () AS n FROM tx)
      SELECT tx_id, CASE WHEN rn <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM h""",
    "split_stratified": f"""WITH {TX}, h AS (SELECT tx_id, is_fraud,
        row_number() OVER (PARTITION BY is_fraud ORDER BY substr(md5(tx_id || '42'), 1, 15)) AS rn,
        count(*) OVER (PARTITION BY is_fraud) AS n FROM tx)
      SELECT tx_id, CAST(is_fraud AS BIGINT) AS is_fraud,
        CASE WHEN rn <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM h""",
    "class_weights": f"""WITH {TX}, c AS (SELECT is_fraud, count(*) AS n FROM tx GROUP BY is_fraud)
      SELECT CAST(is_fraud AS BIGINT) AS is_fraud, n,
        round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM c""",
    "standardize": f"""WITH {TX}, v AS (SELECT tx_id, amount, ln(1 + amount) AS amount_log FROM tx),
      s AS (SELECT avg(amount) AS m1, stddev_pop(amount) AS s1, avg(amount_log) AS m2, stddev_pop(amount_log) AS s2 FROM v)
      SELECT tx_id, round((amount - m1) / s1, 6) AS amount, round((amount_log - m2) / s2, 6) AS amount_log FROM v, s""",
    "run_summary": f"""WITH {RUNS} SELECT run_id, count(*) FILTER (success) AS successful, count(*) AS total,
      bool_and(success) AS success FROM runs GROUP BY run_id""",
    "run_status": f"""WITH {RUNS} SELECT pipeline, max(start_ts) AS last_run,
      round(avg(success::INT)::DOUBLE, 6) AS success_rate, round(avg(duration_ms), 6) AS avg_duration_ms
      FROM runs GROUP BY pipeline""",
    "pipeline_status": f"""WITH {RUNS} SELECT pipeline, max(start_ts) AS last_run,
      round(avg(success::INT)::DOUBLE, 6) AS success_rate, round(avg(duration_ms), 6) AS avg_duration_ms
      FROM runs GROUP BY pipeline""",
    "step_status": f"""WITH {RUNS} SELECT pipeline, step, CAST(start_ts AS DATE) AS day,
      round(avg(duration_ms), 6) AS avg_duration_ms, count(*) AS runs FROM runs GROUP BY ALL""",
    "step_success": f"""WITH {RUNS} SELECT step, count(*) AS runs, count(*) FILTER (success) AS successes,
      round(avg(success::INT)::DOUBLE, 6) AS success_rate FROM runs GROUP BY step""",
    "latency_alerts": f"""WITH {RUNS}, {ALERT_RULES},
      j AS (SELECT seq, step, duration_ms, limit_ms, coalesce(duration_ms > limit_ms, false) AS slow,
        on_error AND NOT success AS failed FROM runs JOIN rules USING (step))
      SELECT seq, step, round(duration_ms, 6) AS duration_ms, limit_ms, slow, failed FROM j WHERE slow OR failed""",
    "metric_stats": f"""WITH {RUNS} SELECT time_bucket(INTERVAL 1 HOUR, start_ts) AS period, step, count(*) AS runs,
      count(*) FILTER (NOT success) AS errors, round(sum(duration_ms), 6) AS sum_ms, round(avg(duration_ms), 6) AS avg_ms,
      round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms FROM runs GROUP BY 1, 2""",
    "resource_totals": f"""WITH {RUNS}, s AS (SELECT pipeline, step, max(memory_mb) AS memory_mb, bool_or(gpu) AS gpu
        FROM runs GROUP BY ALL)
      SELECT pipeline, CAST(sum(memory_mb) AS BIGINT) AS total_memory_mb, bool_or(gpu) AS uses_gpu, count(*) AS steps
      FROM s GROUP BY pipeline""",
    "run_cost": f"""WITH {RUNS}, s AS (SELECT pipeline, count(*) AS step_runs,
        sum(memory_mb / 1024.0::DOUBLE * coalesce(duration_ms / 1000, 10)) AS gb FROM runs GROUP BY pipeline),
      c AS (SELECT pipeline, step_runs, gb * 0.0000166667::DOUBLE AS compute, step_runs * 0.0000002::DOUBLE AS requests,
        step_runs * 2 / 1000.0::DOUBLE * 0.025::DOUBLE AS transitions, 5.0::DOUBLE AS storage, 3.0::DOUBLE AS logs FROM s)
      SELECT pipeline, step_runs, round(compute, 2) AS compute, round(requests, 2) AS requests,
        round(transitions, 2) AS transitions, storage, logs,
        round(compute + requests + transitions + storage + logs, 2) AS total FROM c""",
    "step_errors": f"WITH {RUNS} SELECT run_id, pipeline, step, error, start_ts AS ts FROM runs WHERE NOT success",
    "step_runs_log": f"""WITH {TX}, d AS (SELECT * FROM tx)
      SELECT 'run1' AS run_id, 'daily' AS pipeline, 'load' AS step, true AS success, NULL::VARCHAR AS error,
        count(*) AS rows, true AS timed FROM d
      UNION ALL SELECT 'run1', 'daily', 'stats', true, NULL, count(DISTINCT user_id), true FROM d""",
    "hourly_counts": f"""WITH {TX} SELECT date_trunc('hour', ts) AS window_start, category, count(*) AS n
      FROM tx GROUP BY 1, 2""",
    "map_items": f"""WITH {TX} SELECT tx_id, row_number() OVER (ORDER BY tx_id) - 1 AS item_index,
      round(amount * 2, 6) AS doubled FROM tx""",
    "rf_binary": f"{TEST_ROWS} SELECT tx_id, true AS in_range, true AS decided, true AS learned FROM test",
    "gbt_binary": f"{TEST_ROWS} SELECT tx_id, true AS in_range, true AS decided, true AS learned FROM test",
    "rf_multiclass": """WITH h AS (SELECT vec_id, label,
        row_number() OVER (ORDER BY substr(md5(vec_id || '42'), 1, 15)) AS rn, count(*) OVER () AS n FROM embeddings)
      SELECT vec_id, CAST(label AS BIGINT) AS label, true AS known, true AS learned FROM h WHERE rn <= ceil(n * 0.3::DOUBLE)""",
    "iforest": f"WITH {TX} SELECT tx_id, true AS in_range, true AS decided, true AS share_flagged FROM tx",
    "feature_importance": f"""WITH {TX} SELECT unnest(['amount', 'amount_log', 'amount_zscore', 'hour', 'day_of_week',
        'is_weekend', 'is_night', 'user_avg_amount', 'user_std_amount', 'user_transaction_count',
        'time_since_last_transaction', 'velocity_flag', 'merchant_risk_score', 'high_amount_flag',
        'micro_transaction_flag', 'risky_hour_flag', 'risk_score']) AS feature, true AS in_range, true AS sums_to_one
      UNION ALL SELECT DISTINCT 'payment_' || channel, true, true FROM tx""",
    "score_batch": f"WITH {TX} SELECT tx_id, true AS in_range, true AS weighted, true AS flagged FROM tx",
    "stream_score": f"WITH {TX} SELECT tx_id, true AS in_range, true AS weighted, true AS flagged FROM tx",
    "model_roundtrip": "SELECT event_id AS tx_id, true AS same FROM events",
    "model_registry": "SELECT 'models/forest' AS key, 'PipelineModel' AS model_type, 'risk' AS owner, 100::BIGINT AS trees",
    "stream_hourly": f"""WITH {TX}, m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM tx)
      SELECT date_trunc('hour', ts) AS window_start, category, count(*) AS n, round(sum(amount), 6) AS amount
      FROM tx CROSS JOIN m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2""",
    "stream_late": f"""WITH {TX}, m AS (SELECT max(ts) FILTER (WHERE tx_id % 50 <> 0) - INTERVAL 10 MINUTE AS before,
        max(ts) - INTERVAL 10 MINUTE AS mark FROM tx)
      SELECT date_trunc('hour', ts) AS window_start, category, count(*) AS n,
        count(*) FILTER (WHERE tx_id % 50 = 0 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= before) AS n_late,
        round(sum(amount), 6) AS amount
      FROM tx CROSS JOIN m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2""",
    "stream_velocity": f"""WITH {TX}, {GAPS} SELECT tx_id, user_id, round(gap, 6) AS gap_seconds
      FROM gaps JOIN tx USING (tx_id)""",
    "stream_velocity_bulk": f"""WITH {TX}, {GAPS} SELECT tx_id, user_id, round(gap, 6) AS gap_seconds
      FROM gaps JOIN tx USING (tx_id)""",
    "stream_features": f"""WITH {FEATURES} SELECT tx_id, round(amount_zscore, 6) AS amount_zscore,
      {_cols('', 'high_amount_flag hour velocity_flag')}, round(risk_score, 6) AS risk_score,
      round(time_since_last_transaction, 6) AS time_since_last_transaction FROM feats""",
    "stream_history": f"""WITH {TX}, {GAPS},
      seen AS (SELECT tx_id, user_id, sum(amount) OVER w AS spent, stddev_samp(amount) OVER w AS deviation, count(*) OVER w AS n
        FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY ts, tx_id ROWS UNBOUNDED PRECEDING))
      SELECT tx_id, user_id, round(gap, 6) AS time_since_last_transaction, round(spent, 2) AS user_amount_sum,
        round(deviation, 6) AS user_std_amount, n AS user_transaction_count
      FROM seen JOIN gaps USING (tx_id)""",
    "profile_incremental": f"""WITH {TX} SELECT user_id, round(stddev_samp(amount), 6) AS user_std_amount,
      count(*) AS user_transaction_count, round(sum(amount), 2) AS user_amount_sum FROM tx GROUP BY user_id""",
    "stream_alerts": f"""WITH {SCORED_TX} SELECT tx_id, user_id, {_cols('amount rf_probability')} FROM scored
      WHERE rf_probability > 0.9::DOUBLE""",
}
