"""DuckDB oracle SQL for the query catalog.

Each text recomputes a query from the provided tables with plain SQL, using
the same fixture projections. Double literals are written in e-notation so
DuckDB does not switch to DECIMAL arithmetic.
"""

from __future__ import annotations

from loghawk import constants as C
from loghawk.sources.fixtures import (
    CLASS_PROBABILITIES_DUCKDB, DETECTOR_OUTPUTS_SQL, LOG_LINES_SQL, MODEL_OUTPUTS_SQL, SECURITY_LOGS_SQL,
)


def _dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _weight_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {_dbl(v)}" for k, v in C.SEVERITY_WEIGHTS.items())
    return f"(CASE {whens} ELSE {_dbl(C.DEFAULT_SEVERITY_WEIGHT)} END * 1e2)"


def _bucket(col: str) -> str:
    parts = " ".join(f"WHEN {col} <= {u} THEN '{n}'" for u, n in C.SEVERITY_BANDS)
    return f"(CASE {parts} ELSE '{C.TOP_SEVERITY}' END)"


def r(expr: str, dp: int) -> str:
    """Half-even rounding on the scaled value (the Spark side uses rint)."""
    return f"(round_even(({expr}) * 1e{dp}, 0) / 1e{dp})"


W = C.BLEND_WEIGHTS

# Scored fixture: F2 -> anomaly flag -> frequency -> blend -> rounding.
SCORED_CTE = f"""
f2 AS ({MODEL_OUTPUTS_SQL}),
f2a AS (SELECT *, coalesce(anomaly_score > (SELECT quantile_cont(anomaly_score, 9e-1) FROM f2), false) AS is_anomaly FROM f2),
src_counts AS (SELECT source_ip AS src, count(*) AS src_n FROM f2a WHERE source_ip IS NOT NULL GROUP BY source_ip),
busiest AS (SELECT max(src_n) AS m FROM src_counts),
blend AS (
  SELECT f2a.*, coalesce(src_n / (SELECT m FROM busiest) * 1e2, 0e0) AS freq_raw,
         {_weight_case('attack_type_predicted')} AS sevw_raw
  FROM f2a LEFT JOIN src_counts ON f2a.source_ip = src_counts.src),
blend2 AS (
  SELECT *, least(greatest({_dbl(W['attack'])} * (least(greatest(attack_probability, 0e0), 1e0) * 1e2)
             + {_dbl(W['anomaly'])} * least(greatest(anomaly_score, 0e0), 1e2)
             + {_dbl(W['frequency'])} * freq_raw + {_dbl(W['severity'])} * sevw_raw, 0e0), 1e2) AS threat_raw
  FROM blend),
scored AS (
  SELECT row_id, timestamp, source_ip, destination_ip, protocol, bytes_sent, bytes_received,
         connection_duration, attack_type, predicted_label, attack_type_predicted,
         {r('attack_type_confidence', 4)} AS attack_type_confidence,
         {r('attack_probability', 4)} AS attack_probability,
         {r('anomaly_score', 2)} AS anomaly_score, is_anomaly,
         {r('freq_raw', 2)} AS frequency_score, {r('sevw_raw', 2)} AS severity_weight,
         {r('threat_raw', 2)} AS threat_score, {_bucket('threat_raw')} AS severity
  FROM blend2)
"""

ATTACK_TS_CTE = """
attack_ts AS (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS ts FROM scored WHERE predicted_label = 'Attack'),
attack_ts_ok AS (SELECT * FROM attack_ts WHERE ts IS NOT NULL)
"""

HOURLY_CTE = """
hour_counts AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM attack_ts_ok GROUP BY 1),
bounds AS (SELECT min(hour) AS lo, max(hour) AS hi FROM hour_counts),
grid AS (SELECT lo, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM bounds WHERE lo IS NOT NULL),
hourly AS (SELECT CAST(date_diff('hour', grid.lo, grid.hour) AS BIGINT) AS hour_index, grid.hour AS hour,
                  CAST(coalesce(n, 0) AS BIGINT) AS count
           FROM grid LEFT JOIN hour_counts USING (hour))
"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def scored_query(body: str, *extra: str) -> str:
    return _with(SCORED_CTE, *extra) + body


SEV = C.SEVERITY_DISPLAY_ORDER
HEAT_CELLS = ", ".join(f"CAST(count(threat_score) FILTER (WHERE hour(ts) = {h}) AS BIGINT) AS h{h:02d}"
                       for h in range(24))
DAY_CASE = "CASE " + " ".join(f"WHEN dayname(ts) = '{d}' THEN {i + 1}" for i, d in enumerate(C.DAY_ORDER)) + " END"

ORACLE = {
    "threat_scores": scored_query(
        "SELECT row_id, source_ip, frequency_score, severity_weight, threat_score, severity FROM scored"),
    "scored_logs": scored_query("SELECT * FROM scored"),
    "scan_metrics": scored_query(
        "SELECT count(*) AS total_logs, count(*) FILTER (WHERE predicted_label = 'Normal') AS normal_count,"
        " count(*) FILTER (WHERE predicted_label = 'Attack') AS attack_count,"
        + ", ".join(f" count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_count" for s in SEV)
        + " FROM scored"),
    "kpi_row": scored_query(
        "SELECT total_logs, normal_count, attack_count, critical_count, "
        + r("CASE WHEN total_logs > 0 THEN attack_count / total_logs * 1e2 ELSE 0e0 END", 1)
        + " AS attack_rate FROM (SELECT count(*) AS total_logs,"
        " count(*) FILTER (WHERE predicted_label = 'Normal') AS normal_count,"
        " count(*) FILTER (WHERE predicted_label = 'Attack') AS attack_count,"
        " count(*) FILTER (WHERE severity = 'Critical') AS critical_count FROM scored)"),
    "attack_timeline": scored_query(
        "SELECT date_trunc('hour', ts) AS hour_bucket, predicted_label, count(*) AS count "
        "FROM (SELECT *, TRY_CAST(timestamp AS TIMESTAMP) AS ts FROM scored) WHERE ts IS NOT NULL GROUP BY 1, 2"),
    "severity_distribution": scored_query(
        "SELECT CAST(d.display_order AS INTEGER) AS display_order, d.severity, CAST(coalesce(c.n, 0) AS BIGINT) AS count "
        "FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEV)) + ") d(display_order, severity) "
        "LEFT JOIN (SELECT severity, count(*) AS n FROM scored GROUP BY severity) c USING (severity)"),
    "attack_type_breakdown": scored_query(
        "SELECT attack_type_predicted AS attack_type, count(*) AS count FROM scored "
        "WHERE predicted_label = 'Attack' GROUP BY 1"),
    "top_source_ips": scored_query(
        "SELECT source_ip, count(*) AS count FROM scored WHERE predicted_label = 'Attack' "
        "GROUP BY 1 ORDER BY count DESC, source_ip LIMIT 10"),
    "top_destination_ips": scored_query(
        "SELECT destination_ip, count(*) AS count FROM scored WHERE predicted_label = 'Attack' "
        "GROUP BY 1 ORDER BY count DESC, destination_ip LIMIT 10"),
    "attack_heatmap": scored_query(
        f"SELECT dayname(ts) AS day, {HEAT_CELLS}, CAST(min({DAY_CASE}) AS INTEGER) AS day_order "
        "FROM attack_ts_ok GROUP BY 1", ATTACK_TS_CTE),
    "attack_heatmap_long": scored_query(
        "SELECT dayname(ts) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(threat_score) AS count "
        "FROM attack_ts_ok GROUP BY 1, 2", ATTACK_TS_CTE),
    "threat_leaderboard": scored_query(
        "SELECT CAST(row_number() OVER (ORDER BY " + r("avg_s", 9) + " DESC, source_ip) AS INTEGER) AS rank, "
        "source_ip, events, " + r("avg_s", 1) + " AS avg_threat_score, " + r("max_s", 1) + " AS max_threat_score "
        "FROM (SELECT source_ip, count(*) AS events, avg(threat_score) AS avg_s, max(threat_score) AS max_s "
        "FROM scored WHERE predicted_label = 'Attack' GROUP BY source_ip "
        "ORDER BY " + r("avg(threat_score)", 9) + " DESC, source_ip LIMIT 10)"),
    "hourly_attack_counts": scored_query("SELECT * FROM hourly", ATTACK_TS_CTE, HOURLY_CTE),
    "attack_forecast": scored_query(
        "SELECT CAST(step AS INTEGER) AS step, last_hour + step * INTERVAL 1 HOUR AS forecast_hour, "
        + r("greatest(intercept + slope * CAST(n_hours - 1 + step AS DOUBLE), 0e0)", 6) + " AS forecast "
        "FROM (SELECT sum(count) AS n_attacks, count(*) AS n_hours, max(hour) AS last_hour, "
        "regr_slope(CAST(count AS DOUBLE), CAST(hour_index AS DOUBLE)) AS slope, "
        "regr_intercept(CAST(count AS DOUBLE), CAST(hour_index AS DOUBLE)) AS intercept FROM hourly) f, "
        "range(1, 7) t(step) WHERE n_attacks >= 5 AND n_hours >= 3", ATTACK_TS_CTE, HOURLY_CTE),
    "average_threat_score": scored_query(
        "SELECT " + r("avg(threat_score)", 1) + " AS average_threat_score FROM scored"),
    "top_scored_events": scored_query(
        "SELECT row_id, timestamp, source_ip, destination_ip, attack_type_predicted, attack_probability, "
        "anomaly_score, frequency_score, severity_weight, threat_score, severity FROM scored "
        "ORDER BY threat_score DESC, row_id LIMIT 50"),
    "top_anomalies": scored_query(
        "SELECT row_id, timestamp, source_ip, destination_ip, protocol, bytes_sent, bytes_received, "
        "connection_duration, anomaly_score FROM scored WHERE is_anomaly "
        "ORDER BY anomaly_score DESC, row_id LIMIT 20"),
    "anomaly_summary": scored_query(
        "SELECT count(*) FILTER (WHERE is_anomaly) AS anomalies_flagged, "
        + r("avg(anomaly_score)", 1) + " AS avg_anomaly_score FROM scored"),
    "anomaly_histogram": scored_query(
        "SELECT bin, 0e0 + bin * 25e-1 AS bin_start, 0e0 + (bin + 1) * 25e-1 AS bin_end, count(*) AS count "
        "FROM (SELECT CAST(least(floor((anomaly_score - 0e0) / 25e-1), 39) AS INTEGER) AS bin FROM scored "
        "WHERE anomaly_score IS NOT NULL) GROUP BY bin"),
    "classified_preview": scored_query(
        "SELECT row_id, source_ip, destination_ip, attack_type_predicted AS predicted_attack_type, "
        + r("attack_type_confidence", 3) + " AS confidence FROM scored WHERE predicted_label = 'Attack' "
        "ORDER BY row_id LIMIT 200"),
    "preview_type_counts": scored_query(
        "SELECT attack_type_predicted AS attack_type, count(*) AS count FROM scored "
        "WHERE predicted_label = 'Attack' GROUP BY 1"),
    "detected_count": scored_query(
        "SELECT count(*) FILTER (WHERE predicted_label = 'Attack') AS attacks_flagged, count(*) AS total_rows FROM scored"),
    "table_preview": scored_query("SELECT * FROM scored ORDER BY row_id LIMIT 20"),
}


# ---------------------------------------------------------------- cleaning (P, V)
def _num(c: str) -> str:
    t = f"trim({c})"
    return (f"(CASE WHEN regexp_matches({t}, '[0-9.][dDfF]$') THEN NULL "
            f"WHEN isnan(TRY_CAST({t} AS DOUBLE)) THEN NULL ELSE TRY_CAST({t} AS DOUBLE) END)")


NUMS = C.NUMERIC_COLUMNS
REQ = C.REQUIRED_COLUMNS

CLEAN_CTE = f"""
f1 AS ({SECURITY_LOGS_SQL}),
coerced AS (SELECT row_id, timestamp, source_ip, destination_ip, protocol,
  {', '.join(f'{_num(c)} AS {c}' for c in NUMS)}, attack_type FROM f1),
med AS (SELECT {', '.join(f'quantile_cont({c}, 5e-1) AS {c}' for c in NUMS)} FROM coerced),
filled AS (SELECT row_id, timestamp,
  {', '.join(f"coalesce({c}, 'unknown') AS {c}" for c in C.TEXT_FILL_COLUMNS)},
  {', '.join(f'coalesce(coerced.{c}, (SELECT {c} FROM med), 0e0) AS {c}' for c in NUMS)},
  coalesce(attack_type, 'Unknown') AS attack_type FROM coerced),
tsfill AS (SELECT row_id,
  coalesce(last_value(timestamp IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           (SELECT arg_min(timestamp, row_id) FROM filled WHERE timestamp IS NOT NULL)) AS timestamp,
  source_ip, destination_ip, protocol, {', '.join(NUMS)}, attack_type FROM filled),
dedup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(REQ)} ORDER BY row_id) AS rn
  FROM tsfill) WHERE rn = 1),
quart AS (SELECT {', '.join(f'quantile_cont({c}, [25e-2, 75e-2]) AS {c}' for c in NUMS)} FROM dedup),
outl AS (SELECT dedup.*, coalesce({' OR '.join(
    f'(dedup.{c} < q.{c}[1] - 15e-1 * (q.{c}[2] - q.{c}[1]) OR dedup.{c} > q.{c}[2] + 15e-1 * (q.{c}[2] - q.{c}[1]))'
    for c in NUMS)}, false) AS is_outlier FROM dedup, quart q),
enc AS (SELECT *, CAST(dense_rank() OVER (ORDER BY protocol) - 1 AS INTEGER) AS protocol_encoded FROM outl),
sc AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUMS)} FROM enc),
clean AS (SELECT enc.*, {', '.join(
    f'(enc.{c} - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1e0 ELSE s_{c} END) AS {c}_scaled'
    for c in NUMS)} FROM enc, sc)
"""


def clean_query(body: str) -> str:
    return _with(CLEAN_CTE) + body


SCALED_OUT = ", ".join(f"{r(f'{c}_scaled', 6)} AS {c}_scaled" for c in NUMS)
NON_NUMERIC = " UNION ALL ".join(
    f"SELECT 'non_numeric' AS check, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND {_num(c)} IS NULL) AS count FROM f1"
    for c in NUMS)
NULLS = " UNION ALL ".join(
    f"SELECT 'nulls' AS check, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS count FROM f1" for c in REQ)

ORACLE.update({
    "read_logs": _with(f"f1 AS ({SECURITY_LOGS_SQL})")
        + "SELECT * EXCLUDE (row_id), CAST(row_id AS VARCHAR) AS source_row, "
          "row_number() OVER (ORDER BY row_id) - 1 AS row_id FROM f1",
    "read_logs_rejects": f"SELECT row_id, line AS record, reason FROM ({LOG_LINES_SQL}) WHERE reason IS NOT NULL",
    "landed_counts": _with(f"lines AS ({LOG_LINES_SQL})", f"all_f1 AS ({SECURITY_LOGS_SQL})",
                           "f1 AS (SELECT * FROM all_f1 WHERE row_id IN (SELECT row_id FROM lines WHERE reason IS NULL))")
        + "SELECT name, count FROM (SELECT 'rows' AS name, count(*) AS count FROM f1 UNION ALL SELECT 'stored', count(*) FROM f1 "
        + "UNION ALL SELECT 'rejects', count(*) FROM lines WHERE reason IS NOT NULL "
        + f"UNION ALL SELECT \"check\" || '__' || column_name, count FROM ({NON_NUMERIC}) UNION ALL SELECT \"check\" || '__' || column_name, count FROM ({NULLS}))",
    "validation_counts": _with(f"f1 AS ({SECURITY_LOGS_SQL})") +
        f"SELECT 'rows' AS check, CAST(NULL AS VARCHAR) AS column_name, count(*) AS count FROM f1 UNION ALL {NON_NUMERIC} UNION ALL {NULLS}",
    "coerce_numeric": clean_query(f"SELECT row_id, {', '.join(NUMS)} FROM coerced"),
    "fill_median": clean_query(f"SELECT row_id, {', '.join(NUMS)} FROM filled"),
    "fill_unknown": clean_query(f"SELECT row_id, {', '.join(C.TEXT_FILL_COLUMNS)} FROM filled"),
    "fill_timestamp": clean_query("SELECT row_id, timestamp FROM tsfill"),
    "fill_label": clean_query("SELECT row_id, attack_type FROM filled"),
    "dedup_first": clean_query("SELECT * FROM dedup"),
    "flag_outliers": clean_query("SELECT row_id, is_outlier FROM outl"),
    "encode_protocol": clean_query("SELECT row_id, protocol, protocol_encoded FROM enc"),
    "scale_features": clean_query(f"SELECT row_id, {SCALED_OUT} FROM clean"),
    "clean_logs": clean_query(
        f"SELECT row_id, {', '.join(REQ)}, attack_type, is_outlier, protocol_encoded, {SCALED_OUT} FROM clean"),
    "quality_report": clean_query(
        "SELECT (SELECT count(*) FROM f1) AS original_rows, (SELECT count(*) FROM clean) AS cleaned_rows, "
        "(SELECT count(*) FROM f1) - (SELECT count(*) FROM clean) AS duplicates_removed, "
        "(SELECT CAST(" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in REQ) + " AS BIGINT) FROM coerced) AS missing_values_filled, "
        "(SELECT count(*) FILTER (WHERE is_outlier) FROM clean) AS outliers_flagged"),
})


# ---------------------------------------------------------------- incidents (I)
def _sev_rank(col: str) -> str:
    return "(CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in C.SEVERITY_RANK.items()) + " ELSE 0 END)"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _actions_json(col: str) -> str:
    def lst(acts):
        return "CAST(to_json([" + ", ".join(_sql_str(a) for a in acts) + "]) AS VARCHAR)"
    whens = " ".join(f"WHEN {col} = {_sql_str(k)} THEN {lst(v)}" for k, v in C.RECOMMENDED_ACTIONS.items())
    return f"(CASE {whens} ELSE {lst(C.RECOMMENDED_ACTIONS[C.FALLBACK_ACTION_TYPE])} END)"


INCIDENT_CTE = f"""
flagged AS (SELECT * FROM scored WHERE predicted_label = 'Attack' AND {_sev_rank('severity')} >= 2),
inc_groups AS (SELECT attack_type_predicted, severity, count(*) AS event_count, avg(threat_score) AS avg_s,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  count(DISTINCT destination_ip) AS asset_count, count(DISTINCT source_ip) AS source_count,
  list_slice(list_sort(list(DISTINCT destination_ip)), 1, 10) AS affected_assets,
  list_slice(list_sort(list(DISTINCT source_ip)), 1, 10) AS source_ips
  FROM flagged GROUP BY 1, 2),
inc_num AS (SELECT *, row_number() OVER (ORDER BY attack_type_predicted, severity) AS n FROM inc_groups),
incidents AS (SELECT printf('INC-%d-%04d-%03d', 2024, 1, n) AS incident_id, attack_type_predicted AS threat_type,
  severity, event_count, affected_assets, source_ips, asset_count, source_count, {r('avg_s', 2)} AS avg_threat_score,
  {_actions_json('attack_type_predicted')} AS recommended_actions, first_seen, last_seen,
  CAST(row_number() OVER (ORDER BY {_sev_rank('severity')} DESC, n) AS INTEGER) AS incident_order FROM inc_num)
"""

METRICS_CTE = """
metrics AS (SELECT count(*) AS total_logs, count(*) FILTER (WHERE predicted_label = 'Attack') AS attack_count,
  count(*) FILTER (WHERE severity = 'Critical') AS critical_count, count(*) FILTER (WHERE severity = 'High') AS high_count,
  count(*) FILTER (WHERE severity = 'Medium') AS medium_count, count(*) FILTER (WHERE severity = 'Low') AS low_count
  FROM scored)
"""

ORACLE.update({
    "flag_incident_rows": scored_query(
        f"SELECT row_id, attack_type_predicted, severity FROM scored WHERE predicted_label = 'Attack' AND {_sev_rank('severity')} >= 2"),
    "incident_records": scored_query(
        "SELECT incident_id, threat_type, severity, event_count, array_to_string(affected_assets, ', ') AS affected_assets, "
        "array_to_string(source_ips, ', ') AS source_ips, asset_count, source_count, avg_threat_score, "
        "recommended_actions, first_seen, last_seen, incident_order FROM incidents", INCIDENT_CTE),
    "incident_store_rows": scored_query(
        "SELECT CAST(1 AS BIGINT) AS scan_id, incident_id, threat_type, severity, "
        "array_to_string(affected_assets, ', ') AS affected_assets, recommended_actions FROM incidents", INCIDENT_CTE),
    "executive_summary": scored_query(
        "SELECT CAST(position AS INTEGER) AS position, metric, value FROM (VALUES "
        "(0, 'Total Logs Analyzed', (SELECT CAST(total_logs AS DOUBLE) FROM metrics)), "
        "(1, 'Detected Attacks', (SELECT CAST(attack_count AS DOUBLE) FROM metrics)), "
        "(2, 'Attack Percentage', (SELECT CASE WHEN total_logs > 0 THEN " + r("attack_count / total_logs * 1e2", 1) + " ELSE 0e0 END FROM metrics)), "
        "(3, 'Critical', (SELECT CAST(critical_count AS DOUBLE) FROM metrics)), "
        "(4, 'High', (SELECT CAST(high_count AS DOUBLE) FROM metrics)), "
        "(5, 'Medium', (SELECT CAST(medium_count AS DOUBLE) FROM metrics)), "
        "(6, 'Low', (SELECT CAST(low_count AS DOUBLE) FROM metrics))) t(position, metric, value)", METRICS_CTE),
    "incident_summary": scored_query(
        "SELECT CAST(position AS INTEGER) AS position, metric, CAST(value AS BIGINT) AS value FROM (VALUES "
        "(0, 'Total Logs Analyzed', (SELECT total_logs FROM metrics)), "
        "(1, 'Detected Attacks', (SELECT attack_count FROM metrics)), "
        "(2, 'Critical Threats', (SELECT critical_count FROM metrics)), "
        "(3, 'High Severity Threats', (SELECT high_count FROM metrics)), "
        "(4, 'Total Incidents Reported', (SELECT count(*) FROM incidents))) t(position, metric, value)",
        METRICS_CTE, INCIDENT_CTE),
})


# ---------------------------------------------------------------- models given outputs (M)
DET_CTE = f"""
f5 AS ({DETECTOR_OUTPUTS_SQL}),
ens AS (SELECT row_id, y, is_test, p_rf, p_gbt, (0e0 + p_rf + p_gbt) / 2e0 AS attack_probability FROM f5),
preds AS (SELECT *, CAST(attack_probability >= 5e-1 AS INTEGER) AS ensemble_pred,
  CAST(p_rf >= 5e-1 AS INTEGER) AS rf_pred, CAST(p_gbt >= 5e-1 AS INTEGER) AS gbt_pred FROM ens),
cm AS (SELECT 'random_forest' AS model,
    count(*) FILTER (WHERE y = 0 AND rf_pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND rf_pred = 1) AS fp,
    count(*) FILTER (WHERE y = 1 AND rf_pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND rf_pred = 1) AS tp
  FROM preds WHERE is_test
  UNION ALL SELECT 'gbt',
    count(*) FILTER (WHERE y = 0 AND gbt_pred = 0), count(*) FILTER (WHERE y = 0 AND gbt_pred = 1),
    count(*) FILTER (WHERE y = 1 AND gbt_pred = 0), count(*) FILTER (WHERE y = 1 AND gbt_pred = 1)
  FROM preds WHERE is_test),
met AS (SELECT model,
  {r('CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0e0 END', 4)} AS accuracy,
  {r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END', 4)} AS precision,
  {r('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END', 4)} AS recall,
  {r('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END', 4)} AS f1,
  tn, fp, fn, tp FROM cm)
"""

F6_NAMES = ["Botnet", "DDoS", "Malware", "Port Scan"]

ORACLE.update({
    "binary_label": clean_query(
        "SELECT row_id, CAST(CASE WHEN attack_type <> 'Normal' THEN 1 ELSE 0 END AS INTEGER) AS y FROM clean"),
    "single_class_guard": clean_query(
        "SELECT count(DISTINCT CASE WHEN attack_type <> 'Normal' THEN 1 ELSE 0 END) AS n_classes, "
        "count(DISTINCT CASE WHEN attack_type <> 'Normal' THEN 1 ELSE 0 END) >= 2 AS trainable FROM clean"),
    "classifier_guard": clean_query(
        "SELECT count(*) AS attack_rows, count(DISTINCT attack_type) AS attack_labels, "
        "count(*) >= 10 AND count(DISTINCT attack_type) >= 2 AS trainable FROM clean WHERE attack_type <> 'Normal'"),
    "ensemble_vote": _with(DET_CTE) + "SELECT row_id, attack_probability, ensemble_pred FROM preds",
    "classification_metrics": _with(DET_CTE) + "SELECT * FROM met",
    "confusion_matrix": _with(DET_CTE) +
        "SELECT model, actual, predicted, count FROM met, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted) "
        "CROSS JOIN LATERAL (SELECT CASE WHEN actual = 0 AND predicted = 0 THEN tn WHEN actual = 0 THEN fp "
        "WHEN predicted = 0 THEN fn ELSE tp END AS count)",
    "model_comparison": _with(DET_CTE) +
        "SELECT CAST(position AS INTEGER) AS position, metric, "
        "max(v) FILTER (WHERE model = 'random_forest') AS random_forest, max(v) FILTER (WHERE model = 'gbt') AS gbt "
        "FROM (SELECT model, 0 AS position, 'Accuracy' AS metric, accuracy AS v FROM met UNION ALL "
        "SELECT model, 1, 'Precision', precision FROM met UNION ALL SELECT model, 2, 'Recall', recall FROM met "
        "UNION ALL SELECT model, 3, 'F1 Score', f1 FROM met) GROUP BY position, metric",
    "assign_attack_type": _with(f"f6 AS ({CLASS_PROBABILITIES_DUCKDB})") +
        "SELECT row_id, CASE WHEN detected = 1 THEN (['" + "', '".join(F6_NAMES) + "'])"
        "[list_position(probability, list_max(probability))] ELSE 'Normal' END AS attack_type_predicted, "
        "CASE WHEN detected = 1 THEN list_max(probability) ELSE 0e0 END AS attack_type_confidence FROM f6",
    "assign_attack_type_fallback": _with(f"f6 AS ({CLASS_PROBABILITIES_DUCKDB})") +
        "SELECT row_id, CASE WHEN detected = 1 THEN (CASE WHEN attack_type <> 'Normal' THEN attack_type "
        "ELSE 'Unknown Threat' END) ELSE 'Normal' END AS attack_type_predicted, "
        "CASE WHEN detected = 1 THEN 5e-1 ELSE 0e0 END AS attack_type_confidence FROM f6",
    "anomaly_normalise": _with(f"f2 AS ({MODEL_OUTPUTS_SQL})") +
        "SELECT row_id, " + r("CASE WHEN hi - lo < 1e-9 THEN 0e0 ELSE (anomaly_score - lo) / (hi - lo) * 1e2 END", 6) +
        " AS anomaly_norm FROM f2, (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM f2)",
    "anomaly_flag": _with(f"f2 AS ({MODEL_OUTPUTS_SQL})") +
        "SELECT row_id, coalesce(anomaly_score > (SELECT quantile_cont(anomaly_score, 9e-1) FROM f2), false) AS is_anomaly FROM f2",
})


# ---------------------------------------------------------------- history (H)
from loghawk.sources.fixtures import (  # noqa: E402
    AUDIT_SQL, DELETED_SCANS_SQL, SCANS_SQL, USERS_SQL,
)

HIST_CTE = f"""
users_t AS ({USERS_SQL}),
scans_t AS ({SCANS_SQL}),
audit_t AS ({AUDIT_SQL}),
deleted_t AS ({DELETED_SCANS_SQL})
"""
EVENTS_CTE = """
events_t AS (SELECT CAST(substr(timestamp, 9, 2) AS BIGINT) AS scan_id, timestamp, source_ip, destination_ip,
  protocol, bytes_sent, bytes_received, connection_duration, predicted_label, attack_type, attack_type_predicted,
  attack_type_confidence, attack_probability, anomaly_score, is_anomaly, frequency_score, severity_weight,
  threat_score, severity FROM scored)
"""


def hist(body: str) -> str:
    return _with(HIST_CTE) + body


def hist_events(body: str, *extra: str) -> str:
    return _with(SCORED_CTE, HIST_CTE, EVENTS_CTE, *extra) + body


ORACLE.update({
    "scans_for_user": hist("SELECT * FROM scans_t WHERE user_id = 7"),
    "scan_by_id": hist("SELECT * FROM scans_t WHERE id = 12"),
    "all_scans": hist("SELECT s.id, u.username, s.dataset_name, s.scan_date, s.total_logs, s.threat_count, "
                      "s.critical_count FROM scans_t s JOIN users_t u ON s.user_id = u.id"),
    "delete_scan_scans": hist("SELECT * FROM scans_t WHERE id NOT IN (SELECT scan_id FROM deleted_t)"),
    "delete_scan_events": hist_events("SELECT * FROM events_t WHERE scan_id NOT IN (SELECT scan_id FROM deleted_t)"),
    "count_scans": hist("SELECT count(*) AS scan_count FROM scans_t"),
    "count_users": hist("SELECT count(*) AS user_count FROM users_t"),
    "sum_threats": hist("SELECT CAST(coalesce(sum(threat_count), 0) AS BIGINT) AS total_threats FROM scans_t"),
    "events_for_scan": hist_events("SELECT * FROM events_t WHERE scan_id = 12"),
    "global_top_sources": hist_events(
        "SELECT source_ip, count(*) AS count FROM events_t WHERE predicted_label = 'Attack' "
        "GROUP BY 1 ORDER BY count DESC, source_ip LIMIT 10"),
    "reports_for_scan": scored_query(
        "SELECT CAST(1 AS BIGINT) AS scan_id, incident_id, threat_type, severity, "
        "array_to_string(affected_assets, ', ') AS affected_assets, recommended_actions FROM incidents", INCIDENT_CTE),
    "recent_audit": hist("SELECT * FROM audit_t ORDER BY created_at DESC, id DESC LIMIT 200"),
    "user_totals": hist("SELECT user_id, count(*) AS scans_run, CAST(coalesce(sum(threat_count), 0) AS BIGINT) AS threats_found, "
                        "CAST(coalesce(sum(critical_count), 0) AS BIGINT) AS critical_total FROM scans_t GROUP BY user_id"),
    "user_recent_scans": hist("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY scan_date DESC, id DESC) AS INTEGER) "
                              "AS recent_rank FROM scans_t) WHERE recent_rank <= 5"),
    "list_users": hist("SELECT id, username, email, role, created_at FROM users_t"),
    "scan_report": hist(
        "SELECT id, CAST(json_extract(coalesce(report_json, '{}'), '$.total_logs') AS BIGINT) AS total_logs, "
        "CAST(json_extract(coalesce(report_json, '{}'), '$.normal_count') AS BIGINT) AS normal_count, "
        "CAST(json_extract(coalesce(report_json, '{}'), '$.attack_count') AS BIGINT) AS attack_count, "
        "CAST(json_extract(coalesce(report_json, '{}'), '$.critical_count') AS BIGINT) AS critical_count, "
        "CAST(json_extract(coalesce(report_json, '{}'), '$.high_count') AS BIGINT) AS high_count, "
        "CAST(json_extract(coalesce(report_json, '{}'), '$.medium_count') AS BIGINT) AS medium_count, "
        "CAST(json_extract(coalesce(report_json, '{}'), '$.low_count') AS BIGINT) AS low_count, "
        "array_to_string(CAST(json_extract(coalesce(report_json, '{}'), '$.classification_classes') AS VARCHAR[]), ', ') "
        "AS classification_classes FROM scans_t"),
})


# Answers from the rollups are those from the rows.
ORACLE.update({f"rollup_{name}": ORACLE[name] for name in (
    "kpi_row", "attack_timeline", "severity_distribution", "attack_type_breakdown", "top_source_ips",
    "top_destination_ips", "attack_heatmap", "hourly_attack_counts", "attack_forecast", "global_top_sources")})
ORACLE["scan_dashboard"] = hist_events(
    "SELECT total_logs, normal_count, attack_count, critical_count, "
    + r("CASE WHEN total_logs > 0 THEN attack_count / total_logs * 1e2 ELSE 0e0 END", 1)
    + " AS attack_rate FROM (SELECT count(*) AS total_logs,"
    " count(*) FILTER (WHERE predicted_label = 'Normal') AS normal_count,"
    " count(*) FILTER (WHERE predicted_label = 'Attack') AS attack_count,"
    " count(*) FILTER (WHERE severity = 'Critical') AS critical_count FROM events_t WHERE scan_id = 12)")


# ---------------------------------------------------------------- sources / sinks (S)
ORACLE.update({
    "export_csv": scored_query("SELECT * FROM scored"),
    "export_json": scored_query("SELECT * FROM scored"),
    "write_events": hist_events(
        "SELECT timestamp, source_ip, destination_ip, protocol, bytes_sent, bytes_received, connection_duration, "
        "predicted_label, attack_type, attack_type_predicted, attack_type_confidence, attack_probability, "
        "anomaly_score, is_anomaly, frequency_score, severity_weight, threat_score, severity, "
        "CAST(3 AS BIGINT) AS scan_id FROM events_t"),
    "write_scan": scored_query(
        "SELECT CAST(3 AS BIGINT) AS id, count(*) AS total_logs, count(*) FILTER (WHERE predicted_label = 'Normal') AS normal_count, "
        "count(*) FILTER (WHERE predicted_label = 'Attack') AS attack_count, "
        + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_count" for s in SEV) + " FROM scored"),
    "write_incidents": scored_query(
        "SELECT incident_id, threat_type, severity, array_to_string(affected_assets, ', ') AS affected_assets, "
        "recommended_actions, CAST(1 AS BIGINT) AS scan_id FROM incidents", INCIDENT_CTE),
    "write_audit": hist("SELECT * FROM audit_t"),
})


# ---------------------------------------------------------------- split-out projections
ORACLE.update({
    "non_numeric_counts": _with(f"f1 AS ({SECURITY_LOGS_SQL})") + f"SELECT column_name, count FROM ({NON_NUMERIC})",
    "null_counts": _with(f"f1 AS ({SECURITY_LOGS_SQL})") + f"SELECT column_name, count FROM ({NULLS}) WHERE count > 0",
    "is_empty": _with(f"f1 AS ({SECURITY_LOGS_SQL})") + "SELECT count(*) = 0 AS is_empty FROM f1",
    "validate_columns": _with(f"f1 AS ({SECURITY_LOGS_SQL})")
        + "SELECT 'all' AS table_name, '' AS missing, count(*) AS row_count FROM f1 "
          "UNION ALL SELECT 'cut', 'protocol, bytes_sent', count(*) FROM f1",
    "feature_matrix": clean_query(
        f"SELECT row_id, {r('bytes_sent_scaled', 6)} AS f0, {r('bytes_received_scaled', 6)} AS f1, "
        f"{r('connection_duration_scaled', 6)} AS f2, {r('CAST(protocol_encoded AS DOUBLE)', 6)} AS f3 FROM clean"),
    "incident_ids": scored_query("SELECT incident_id, threat_type, severity FROM incidents", INCIDENT_CTE),
    "recommended_actions": scored_query("SELECT threat_type, recommended_actions FROM incidents", INCIDENT_CTE),
    "incident_order": scored_query("SELECT incident_id, incident_order FROM incidents", INCIDENT_CTE),
    "frequency_score": scored_query(
        "SELECT row_id, source_ip, " + r("freq_raw", 6) + " AS frequency_score FROM blend"),
})


# ---------------------------------------------------------------- portable-hash orders
def _pkey(col: str, seed: int) -> str:
    return f"('0x' || substr(md5(CAST({col} AS VARCHAR) || ':{seed}'), 1, 15))::BIGINT"


ORACLE.update({
    "traffic_sample": scored_query(
        "SELECT bytes_sent, bytes_received, predicted_label, connection_duration, source_ip, destination_ip, "
        f"attack_type_predicted FROM scored ORDER BY {_pkey('row_id', 42)}, row_id LIMIT 2000"),
    "stratified_split": clean_query(
        "SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY k, row_id) <= ceil(25e-2 * count(*) OVER (PARTITION BY y)) "
        f"AS is_test FROM (SELECT row_id, CAST(CASE WHEN attack_type <> 'Normal' THEN 1 ELSE 0 END AS INTEGER) AS y, "
        f"{_pkey('row_id', 42)} AS k FROM clean)"),
})


# ---------------------------------------------------------------- fitted models: what must hold
_TABLE = "SELECT count(*) AS row_count, count(DISTINCT row_id) AS id_count, CAST(0 AS BIGINT) AS out_of_range"
_IS_ATTACK = "attack_type IS DISTINCT FROM 'Normal'"
_TESTS = (f", CAST(ceil(25e-2 * count(*) FILTER (WHERE NOT {_IS_ATTACK})) AS BIGINT) AS test_rows_0"
          f", CAST(ceil(25e-2 * count(*) FILTER (WHERE {_IS_ATTACK})) AS BIGINT) AS test_rows_1")
_PER_CLASS = f"SELECT attack_type, ceil(25e-2 * count(*)) AS n FROM clean WHERE {_IS_ATTACK} GROUP BY 1"
ORACLE.update({
    "detect_rf": clean_query(_TABLE + _TESTS + ", true AS beats_majority FROM clean"),
    "detect_gbt": clean_query(_TABLE + _TESTS + ", true AS beats_majority FROM clean"),
    "detect_attacks": clean_query(_TABLE + _TESTS + ", CAST(0 AS BIGINT) AS not_the_mean, true AS beats_majority FROM clean"),
    "detection_metrics": clean_query(
        "SELECT model, CAST(t.test_rows_0 + t.test_rows_1 AS BIGINT) AS test_rows, t.test_rows_1 AS test_attacks, "
        f"true AS in_range, true AS beats_constant FROM ({_TABLE}{_TESTS} FROM clean) t, "
        "(SELECT unnest(['random_forest', 'gbt']) AS model)"),
    "classify_attacks": clean_query(
        _TABLE + ", CAST(0 AS BIGINT) AS not_summing, CAST(0 AS BIGINT) AS unexpected_type, "
        f"count(DISTINCT attack_type) FILTER (WHERE {_IS_ATTACK}) AS classes FROM clean"),
    "classification_accuracy": clean_query(
        f"SELECT true AS in_range, CAST(sum(n) AS BIGINT) AS test_rows, true AS beats_majority FROM ({_PER_CLASS})"),
    "isolation_forest": clean_query(
        _TABLE + ", 0e0 AS score_min, 1e2 AS score_max, true AS share_flagged, true AS flags_highest FROM clean"),
    "run_pipeline": clean_query(
        _TABLE + ", CAST(0 AS BIGINT) AS unknown_severity, CAST(0 AS BIGINT) AS label_conflicts, "
        "CAST(0 AS BIGINT) AS anomaly_out_of_range, CAST(0 AS BIGINT) AS score_differs, CAST(0 AS BIGINT) AS severity_differs, "
        "true AS metrics_agree, true AS beats_majority FROM clean"),
})
ORACLE["score_with_saved_models"] = clean_query(
    "SELECT count(*) AS row_count, count(*) AS rescored_count, CAST(0 AS BIGINT) AS differs FROM clean")
ORACLE["write_scan"] = (f"SELECT w.*, m.f1 AS forest_f1 FROM ({ORACLE['write_scan']}) w, "
                        f"({ORACLE['classification_metrics']}) m WHERE m.model = 'random_forest'")
