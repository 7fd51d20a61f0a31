"""Test fixtures projected from the provided ``events`` table.

The SQL texts run unchanged in Spark and in DuckDB, so a query and its
oracle read cell-identical inputs. They are projections of the whole table;
the modulo arithmetic decides which cells are dirty, never which rows exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loghawk.sources.tables import register_tables

# raw security logs, all columns strings as read from CSV, with nulls,
# non-numeric cells and 2% repeated rows. Most attacks send and last longer.
SECURITY_LOGS_SQL = """
WITH base AS (
SELECT event_id AS row_id,
  CASE WHEN event_id % 103 = 0 THEN NULL ELSE substr(cast(ts AS string), 1, 19) END AS timestamp,
  CASE WHEN event_id % 107 = 0 THEN NULL ELSE concat('203.0.113.', cast(user_id AS string)) END AS source_ip,
  concat('10.0.', cast(event_id % 4 AS string), '.', cast(event_id % 23 AS string)) AS destination_ip,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'TCP' WHEN event_id % 5 = 1 THEN 'UDP'
       WHEN event_id % 5 = 2 THEN 'ICMP' WHEN event_id % 5 = 3 THEN 'HTTP' ELSE 'HTTPS' END AS protocol,
  CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE cast(cast(floor(value * 1e2) AS bigint)
       + CASE WHEN event_type = 'error' AND event_id % 10 < 8 THEN 60000 ELSE 0 END AS string) END AS bytes_sent,
  CASE WHEN event_id % 109 = 0 THEN NULL ELSE cast(cast(floor(value * 1e2) AS bigint) * (1 + event_id % 3) AS string) END AS bytes_received,
  cast(1 + event_id % 100 + CASE WHEN event_type = 'error' THEN 40 ELSE 0 END AS string) AS connection_duration,
  CASE WHEN event_id % 113 = 0 THEN NULL WHEN event_type <> 'error' THEN 'Normal'
       WHEN event_id % 9 = 0 THEN 'DDoS' WHEN event_id % 9 = 1 THEN 'DoS' WHEN event_id % 9 = 2 THEN 'Brute Force'
       WHEN event_id % 9 = 3 THEN 'Port Scan' WHEN event_id % 9 = 4 THEN 'SQL Injection' WHEN event_id % 9 = 5 THEN 'Botnet'
       WHEN event_id % 9 = 6 THEN 'Malware' WHEN event_id % 9 = 7 THEN 'Phishing' ELSE 'Unknown Threat' END AS attack_type
FROM events)
SELECT * FROM base
UNION ALL
SELECT row_id + 100000000 AS row_id, timestamp, source_ip, destination_ip, protocol,
       bytes_sent, bytes_received, connection_duration, attack_type
FROM base WHERE row_id % 50 = 0
"""

# F1 as lines of CSV text; some records have cells to spare, some too few.
LOG_LINES_SQL = f"""
SELECT row_id, concat_ws(',', cast(row_id AS string), coalesce(timestamp, ''), coalesce(source_ip, ''),
  CASE WHEN row_id % 43 = 0 THEN NULL ELSE concat_ws(',', destination_ip, coalesce(protocol, ''), coalesce(bytes_sent, ''),
    coalesce(bytes_received, ''), connection_duration, coalesce(attack_type, '')) END,
  CASE WHEN row_id % 43 > 0 AND row_id % 41 = 0 THEN 'more,' ELSE NULL END) AS line,
  CASE WHEN row_id % 43 = 0 THEN 'fewer cells than the header' WHEN row_id % 41 = 0 THEN 'more cells than the header' END AS reason
FROM ({SECURITY_LOGS_SQL}) AS logs
"""
LOG_HEADER = ("source_row,timestamp,source_ip,destination_ip,protocol,bytes_sent,bytes_received,"
              "connection_duration,attack_type")

# deterministic model outputs standing in for trained models, plus the
# raw log columns of the same event (one projection, no self-join).
MODEL_OUTPUTS_SQL = """
SELECT event_id AS row_id, substr(cast(ts AS string), 1, 19) AS timestamp,
  concat('203.0.113.', cast(user_id AS string)) AS source_ip,
  concat('10.0.', cast(event_id % 4 AS string), '.', cast(event_id % 23 AS string)) AS destination_ip,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'TCP' WHEN event_id % 5 = 1 THEN 'UDP'
       WHEN event_id % 5 = 2 THEN 'ICMP' WHEN event_id % 5 = 3 THEN 'HTTP' ELSE 'HTTPS' END AS protocol,
  TRY_CAST(CASE WHEN event_id % 101 = 0 THEN 'bad' ELSE cast(cast(floor(value * 1e2) AS bigint) AS string) END AS double) AS bytes_sent,
  TRY_CAST(CASE WHEN event_id % 109 = 0 THEN NULL ELSE cast(cast(floor(value * 1e2) AS bigint) * (1 + event_id % 3) AS string) END AS double) AS bytes_received,
  cast(1 + event_id % 100 AS double) AS connection_duration,
  CASE WHEN event_id % 113 = 0 THEN 'Unknown' WHEN event_type <> 'error' THEN 'Normal'
       WHEN event_id % 9 = 0 THEN 'DDoS' WHEN event_id % 9 = 1 THEN 'DoS' WHEN event_id % 9 = 2 THEN 'Brute Force'
       WHEN event_id % 9 = 3 THEN 'Port Scan' WHEN event_id % 9 = 4 THEN 'SQL Injection' WHEN event_id % 9 = 5 THEN 'Botnet'
       WHEN event_id % 9 = 6 THEN 'Malware' WHEN event_id % 9 = 7 THEN 'Phishing' ELSE 'Unknown Threat' END AS attack_type,
  CASE WHEN event_type = 'error' THEN 5e-1 + (event_id % 50) / 1e2 ELSE (event_id % 50) / 1e2 END AS attack_probability,
  value * 1e2 / (value + 5e1) AS anomaly_score,
  CASE WHEN event_type <> 'error' THEN 'Normal' WHEN event_id % 7 < 3 THEN 'DDoS' WHEN event_id % 7 < 5 THEN 'Port Scan'
       WHEN event_id % 7 = 5 THEN 'Malware' ELSE 'Unknown' END AS attack_type_predicted,
  CASE WHEN event_type = 'error' THEN 'Attack' ELSE 'Normal' END AS predicted_label,
  CASE WHEN event_type = 'error' THEN 6e-1 + (event_id % 40) / 1e2 ELSE 0e0 END AS attack_type_confidence
FROM events
"""

# two detectors' probabilities and the true label, for the metric operators.
DETECTOR_OUTPUTS_SQL = """
SELECT event_id AS row_id,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
  CASE WHEN event_type = 'error' THEN 45e-2 + (event_id % 50) / 1e2 ELSE (event_id % 60) / 1e2 END AS p_rf,
  CASE WHEN event_type = 'error' THEN 35e-2 + (event_id % 60) / 1e2 ELSE (event_id % 52) / 1e2 END AS p_gbt,
  CASE WHEN event_id % 4 = 0 THEN true ELSE false END AS is_test
FROM events
"""

# class probabilities of a multiclass model for every row. ``{array}`` is
# the engine's array constructor (Spark: array, DuckDB: list_value).
CLASS_PROBABILITIES_TEMPLATE = """
SELECT event_id AS row_id,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS detected,
  CASE WHEN event_type = 'error' THEN 'Malware' ELSE 'Normal' END AS attack_type,
  {array}(cast((event_id % 7) AS double) / 1e1, cast((event_id % 5) AS double) / 1e1,
        cast((event_id % 3) AS double) / 1e1, cast((user_id % 4) AS double) / 1e1) AS probability
FROM events
"""
CLASS_PROBABILITIES_SQL = CLASS_PROBABILITIES_TEMPLATE.format(array="array")
CLASS_PROBABILITIES_DUCKDB = CLASS_PROBABILITIES_TEMPLATE.format(array="list_value")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register_tables(spark, sf_dir, ("events",))
    return spark.sql(text)


def security_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SECURITY_LOGS_SQL)


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MODEL_OUTPUTS_SQL)


def detector_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, DETECTOR_OUTPUTS_SQL)


def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CLASS_PROBABILITIES_SQL)


# History fixtures: the scan store's tables derived from customer and orders.
USERS_SQL = """
SELECT c_custkey AS id, c_name AS username,
  concat(lower(replace(c_name, '#', '.')), '@example.com') AS email,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'analyst' END AS role,
  concat('2023-01-01 ', lpad(cast(c_custkey % 24 AS string), 2, '0'), ':00:00') AS created_at
FROM customer
"""

SCANS_SQL = """
SELECT o_orderkey AS id, o_custkey AS user_id,
  concat('logs_', cast(o_orderkey AS string), '.csv') AS dataset_name,
  substr(cast(o_orderdate AS string), 1, 19) AS scan_date,
  cast(floor(o_totalprice / 1e1) AS bigint) AS total_logs,
  cast(floor(o_totalprice / 1e3) AS bigint) AS threat_count,
  cast(floor(o_totalprice / 1e4) AS bigint) AS critical_count,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('{"total_logs": ',
    cast(cast(floor(o_totalprice / 1e1) AS bigint) AS string), ', "attack_count": ',
    cast(cast(floor(o_totalprice / 1e3) AS bigint) AS string),
    ', "classification_classes": ["DDoS", "Malware"]}') END AS report_json
FROM orders
"""

AUDIT_SQL = """
SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE WHEN o_orderstatus = 'F' THEN 'run_scan' WHEN o_orderstatus = 'O' THEN 'export' ELSE 'login' END AS action,
  concat('Scan #', cast(o_orderkey AS string)) AS details,
  substr(cast(o_orderdate AS string), 1, 19) AS created_at
FROM orders
"""

DELETED_SCANS_SQL = """
SELECT o_orderkey AS scan_id FROM orders WHERE o_orderpriority = '5-LOW'
"""


def _tables_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register_tables(spark, sf_dir, ("customer", "orders"))
    return spark.sql(text)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_sql(spark, sf_dir, USERS_SQL)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_sql(spark, sf_dir, SCANS_SQL)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_sql(spark, sf_dir, AUDIT_SQL)


def deleted_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables_sql(spark, sf_dir, DELETED_SCANS_SQL)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir)
    return spark.sql(LOG_LINES_SQL)
