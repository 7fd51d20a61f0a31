"""Hand-made frames for the edge cases of the cleaning, scoring and analyst operators."""

import math

import pytest

from pyspark.sql import functions as F

from loghawk import constants as C
from loghawk.functions import parse_number
from loghawk.operators import analytics as A
from loghawk.operators import incidents as I
from loghawk.operators import prepare as P
from loghawk.operators import quality as V
from loghawk.operators import scoring as T
from tests.conftest import rows

LOG_COLS = ["row_id", *C.REQUIRED_COLUMNS, "attack_type"]


def logs(spark, data, cols=LOG_COLS):
    schema = ", ".join(f"{c} {'bigint' if c == 'row_id' else 'string'}" for c in cols)
    return spark.createDataFrame(data, schema)


def row(i, ts="2024-01-01 00:00:00", src="1.1.1.1", dst="10.0.0.1", proto="TCP", bs="10", br="20", dur="1", label="Normal"):
    return (i, ts, src, dst, proto, bs, br, dur, label)


def test_parse_number_rules(spark):
    df = spark.createDataFrame([(s,) for s in ["12", " 12 ", "1e3", ".5", "+7", "inf", "1d", "5f", "NaN", "bad", None]], "v string")
    got = [r[0] for r in df.select(parse_number("v")).collect()]
    assert got[:5] == [12.0, 12.0, 1000.0, 0.5, 7.0]
    assert math.isinf(got[5])
    assert got[6:] == [None, None, None, None, None]


def test_all_null_numeric_column_fills_zero(spark):
    df = logs(spark, [row(0, bs=None), row(1, bs=None)])
    out = P.fill_median(P.coerce_numeric(df))
    assert [r[0] for r in out.select("bytes_sent").collect()] == [0.0, 0.0]


def test_median_is_interpolated(spark):
    df = logs(spark, [row(0, bs="1"), row(1, bs="2"), row(2, bs="4"), row(3, bs="7"), row(4, bs=None)])
    out = P.fill_median(P.coerce_numeric(df)).where("row_id = 4")
    assert rows(out, "bytes_sent") == [(3.0,)]


def test_forward_then_backward_fill(spark):
    df = logs(spark, [row(0, ts=None), row(1, ts=None), row(2, ts="a"), row(3, ts=None), row(5, ts="b"), row(9, ts=None)])
    for parts in (1, 2, 6):
        out = P.forward_back_fill(df.repartition(parts), "timestamp").orderBy("row_id")
        assert [r[0] for r in out.select("timestamp").collect()] == ["a", "a", "a", "a", "b", "b"], parts


def test_fill_asks_nothing_of_the_ids(spark):
    """Ids spread over 2^60, negative ones among them: one carry row a partition, and the fill of a plain scan."""
    import random
    r = random.Random(4)
    ids = sorted(r.randrange(-2 ** 59, 2 ** 59) for _ in range(4000))
    data = [(i, f"t{k}" if r.random() < 0.01 and k > 300 else None, k % 7) for k, i in enumerate(ids)]
    df = spark.createDataFrame(data, "row_id long, timestamp string, other int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = P._filled_inside(df, "timestamp", "row_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    carry = P.fill_carry(stored, "timestamp", "row_id")
    assert 1 < carry.count() == stored.select("_part").distinct().count() <= 8
    first = next(t for _, t, _ in data if t is not None)
    expected, last = [], first
    for i, t, o in data:
        last = t if t is not None else last
        expected.append((i, last, o))
    got = P.forward_back_fill(df, "timestamp").orderBy("row_id").collect()
    assert [tuple(x) for x in got] == expected


def test_fill_all_null_timestamps_stays_null(spark):
    df = logs(spark, [row(0, ts=None), row(1, ts=None)])
    assert rows(P.forward_back_fill(df, "timestamp"), "timestamp") == [(None,), (None,)]


def test_duplicate_differing_only_in_label_keeps_first(spark):
    df = logs(spark, [row(3, label="DDoS"), row(1, label="Normal"), row(2, src="9.9.9.9")])
    out = P.dedup_first(df).orderBy("row_id")
    assert rows(out, "row_id", "attack_type") == [(1, "Normal"), (2, "Normal")]


def test_missing_label_column_becomes_unknown(spark):
    df = logs(spark, [row(0)[:-1]], LOG_COLS[:-1])
    assert rows(P.fill_label(df), "attack_type") == [("Unknown",)]


def test_zero_iqr_flags_any_deviation_and_zero_variance_scales_to_zero(spark):
    df = P.coerce_numeric(logs(spark, [row(i) for i in range(8)] + [row(8, bs="11")]))
    out = P.outlier_and_scale(df).orderBy("row_id")
    flags = [r[0] for r in out.select("is_outlier").collect()]
    assert flags == [False] * 8 + [True]
    assert {r[0] for r in out.select("bytes_received_scaled").collect()} == {0.0}


def test_single_protocol_encodes_zero(spark):
    df = logs(spark, [row(0), row(1, src="2.2.2.2")])
    assert {r[0] for r in P.encode_protocol(df, P.protocol_codes(df)).select("protocol_encoded").collect()} == {0}
    assert {r[0] for r in P.encode_protocol(df).select("protocol_encoded").collect()} == {0}


def test_validate_messages(spark):
    df = logs(spark, [row(0, bs="bad", src=None), row(1)])
    ok, issues = V.validate(df)
    assert ok
    assert "bytes_sent: 1 cells are no numbers and count as missing" in issues
    assert "source_ip: 1 cells are empty" in issues
    ok, issues = V.validate(df.drop("protocol"))
    assert not ok and issues == ["Required columns not in the file: protocol"]
    ok, issues = V.validate(df.limit(0))
    assert not ok and issues[-1] == "The file has a header and no rows"


def scored_frame(spark, data):
    """(row_id, timestamp, src, dst, label, type, prob, anomaly)."""
    df = spark.createDataFrame(data, "row_id bigint, timestamp string, source_ip string, destination_ip string, "
                                     "predicted_label string, attack_type_predicted string, attack_probability double, "
                                     "anomaly_score double")
    return T.threat_scores(df)


def test_score_bands_use_unrounded_score(spark):
    # one source -> frequency 100; Normal weight 0: score = .35*100p + .25a + 20
    data = [(0, "2024-01-01 00:00:00", "s", "d", "Normal", "Normal", 0.0, 0.0),
            (1, "2024-01-01 00:00:00", "s", "d", "Normal", "Normal", 0.0, 0.004),
            (2, "2024-01-01 00:00:00", "s", "d", "Normal", "Normal", 0.0, 120.0)]
    out = scored_frame(spark, data).orderBy("row_id")
    got = rows(out, "threat_score", "severity")
    assert got[0] == (20.0, "Low")
    assert got[1] == (20.0, "Medium")  # 20.001 shows as 20.00 but is above the band edge
    assert got[2] == (45.0, "Medium")  # anomaly clipped at 100


def test_unknown_type_weighs_fifty(spark):
    data = [(0, "2024-01-01 00:00:00", "s", "d", "Attack", "Something", 1.0, 100.0)]
    out = scored_frame(spark, data)
    assert rows(out, "severity_weight", "threat_score", "severity") == [(50.0, 90.0, "Critical")]


def test_forecast_guards(spark):
    def frame(hours):
        data = [(i, f"2024-01-01 {h:02d}:10:00", "s", "d", "Attack", "DDoS", 0.9, 1.0) for i, h in enumerate(hours)]
        return scored_frame(spark, data)
    assert A.attack_forecast(frame([0, 1, 2, 3])).count() == 0          # 4 attacks
    assert A.attack_forecast(frame([0, 0, 0, 1, 1])).count() == 0       # 2 hours
    out = A.attack_forecast(frame([0, 0, 0, 1, 1, 3])).orderBy("step")  # gap at hour 2 counts 0
    hourly = rows(A.hourly_attack_counts(frame([0, 0, 0, 1, 1, 3])).orderBy("hour_index"), "count")
    assert hourly == [(3,), (2,), (0,), (1,)]
    assert out.count() == 6
    assert all(r[0] >= 0 for r in out.select("forecast").collect())


def test_incident_threshold_and_ip_lists(spark):
    data = [(i, f"2024-01-01 00:{i:02d}:00", f"src{i:02d}", f"dst{i:02d}", "Attack", "DDoS", 1.0, 100.0) for i in range(12)]
    data.append((99, "2024-01-01 01:00:00", "x", "y", "Attack", "Port Scan", 0.0, 0.0))
    out = I.incident_records(scored_frame(spark, data), scan_id=7, year=2024)
    recs = out.collect()
    assert len(recs) == 1  # the Port Scan row is below High
    rec = recs[0]
    assert rec["incident_id"] == "INC-2024-0007-001"
    assert rec["affected_assets"] == [f"dst{i:02d}" for i in range(10)]
    assert rec["event_count"] == 12
    assert rec["first_seen"] == "2024-01-01 00:00:00" and rec["last_seen"] == "2024-01-01 00:11:00"
    assert rec["recommended_actions"] == C.RECOMMENDED_ACTIONS["DDoS"]


def test_unknown_type_gets_fallback_actions(spark):
    df = spark.createDataFrame([("Unknown",)], "t string")
    got = df.select(I.actions_for(F.col("t"))).first()[0]
    assert got == C.RECOMMENDED_ACTIONS["Unknown Threat"]


def test_severity_distribution_fills_missing(spark):
    data = [(0, "2024-01-01 00:00:00", "s", "d", "Normal", "Normal", 0.0, 0.0)]
    out = A.severity_distribution(scored_frame(spark, data)).orderBy("display_order")
    assert rows(out, "severity", "count") == [("Critical", 0), ("High", 0), ("Medium", 0), ("Low", 1)]


def test_unparsable_timestamp_dropped_from_timeline(spark):
    data = [(0, "bad", "s", "d", "Attack", "DDoS", 1.0, 0.0), (1, "2024-01-01 05:30:00", "s", "d", "Attack", "DDoS", 1.0, 0.0)]
    out = A.attack_timeline(scored_frame(spark, data))
    assert out.count() == 1 and out.first()["count"] == 1


def test_hot_key_holding_a_third_of_rows(spark):
    # 3000 rows: 1000 copies of one log line from one source, 2000 distinct lines.
    hot = [row(i, src="6.6.6.6", dst="10.0.0.9", label="DDoS") for i in range(1000)]
    rest = [row(1000 + i, ts=f"2024-01-01 00:{i % 60:02d}:00", src=f"7.7.{i % 50}.{i % 7}",
                dst=f"10.0.1.{i % 9}", bs=str(i)) for i in range(2000)]
    df = P.coerce_numeric(logs(spark, hot + rest)).repartition(8)
    dd = P.dedup_first(df)
    assert dd.count() == 2001
    assert rows(dd.where("source_ip = '6.6.6.6'"), "row_id", "attack_type") == [(0, "DDoS")]
    scored_in = df.withColumns({"predicted_label": F.lit("Attack"), "attack_type_predicted": F.lit("DDoS"),
                                "attack_probability": F.lit(1.0), "anomaly_score": F.lit(0.0)})
    sc = T.threat_scores(scored_in)
    assert rows(sc.where("source_ip = '6.6.6.6'").select("frequency_score").distinct()) == [(100.0,)]
    top = A.threat_leaderboard(sc).first()
    assert top["source_ip"] == "6.6.6.6" and top["events"] == 1000
    inc = I.incident_records(sc, scan_id=1, min_severity="Low", year=2024).collect()
    assert sum(r["event_count"] for r in inc) == 3000
    assert all(len(r["affected_assets"]) <= 10 for r in inc)


def test_heatmap_days_in_week_order_with_24_hours(spark):
    days = ["2024-01-07", "2024-01-01", "2024-01-03"]  # Sunday, Monday, Wednesday
    data = [(i, f"{d} 23:00:00", "s", "d", "Attack", "DDoS", 1.0, 0.0) for i, d in enumerate(days)]
    out = A.attack_heatmap(scored_frame(spark, data))
    recs = out.collect()
    assert [r["day"] for r in recs] == ["Monday", "Wednesday", "Sunday"]
    assert len([c for c in out.columns if c.startswith("h")]) == 24
    assert all(r["h23"] == 1 and r["h00"] == 0 for r in recs)


def test_histogram_top_edge_in_last_bin(spark):
    data = [(i, "2024-01-01 00:00:00", "s", "d", "Normal", "Normal", 0.0, a)
            for i, a in enumerate([0.0, 2.49, 2.5, 100.0])]
    got = sorted(rows(A.anomaly_histogram(scored_frame(spark, data)), "bin", "count"))
    assert got == [(0, 2), (1, 1), (39, 1)]


def test_incident_numbers_follow_type_order_and_records_follow_severity(spark):
    data = [(0, "2024-01-01 00:00:00", "a", "x", "Attack", "Malware", 1.0, 100.0),   # Critical
            (1, "2024-01-01 00:00:00", "b", "y", "Attack", "DDoS", 0.5, 20.0),      # High
            (2, "2024-01-01 00:00:00", "b", "y", "Attack", "DDoS", 1.0, 100.0)]     # Critical
    recs = I.incident_records(scored_frame(spark, data), scan_id=3, year=2024).orderBy("incident_order").collect()
    got = [(r["incident_id"], r["threat_type"], r["severity"]) for r in recs]
    assert got == [("INC-2024-0003-001", "DDoS", "Critical"), ("INC-2024-0003-003", "Malware", "Critical"),
                   ("INC-2024-0003-002", "DDoS", "High")]


@pytest.mark.parametrize("counted", [20, 1 << 16])
def test_exact_quantiles(spark, counted):
    import numpy as np

    from loghawk.functions.stats import quantiles
    rng = np.random.default_rng(3)
    inf = float("inf")
    columns = {
        "uniform": rng.uniform(-5, 5, 400).tolist(), "skewed": [float(2.0 ** k) for k in rng.integers(-60, 60, 400)],
        "ties": [float(k) for k in rng.integers(0, 3, 400)], "flat": [7.0] * 400,
        "ends": [inf, -inf, -inf, 1e308, -1e308] + [0.5] * 5 + [None] * 390, "none": [None] * 400,
        "gaps": [None if k % 3 else float(k) for k in range(400)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, list(columns), probs, counted)
    for c, values in columns.items():
        there = sorted(v for v in values if v is not None)
        if not there:
            assert got[c] == [None] * len(probs)
            continue
        for p, q in zip(probs, got[c]):
            x = p * (len(there) - 1)
            lo, hi = there[math.floor(x)], there[math.ceil(x)]
            expected = lo if lo == hi or x == int(x) else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi
            assert q == expected or abs(q - expected) <= 1e-12 * abs(expected), (c, p, q, expected)


def test_quantiles_take_few_passes_on_any_values(spark):
    """At most 4 passes over uniform, lognormal, heavily tied and powers-of-two values, and still exact."""
    import numpy as np

    from loghawk.functions.stats import describe
    rng = np.random.default_rng(11)
    n = 60_000
    columns = {"uniform": rng.uniform(0, 1, n), "lognormal": rng.lognormal(0, 6, n), "powers": 2.0 ** rng.integers(-1000, 1000, n),
               "tied": rng.integers(0, 5, n).astype(float)}
    df = spark.createDataFrame(__import__("pandas").DataFrame(columns)).repartition(8)
    probs = [0.01, 0.25, 0.5, 0.75, 0.9, 0.999]
    for counted, most in ((1 << 16, 2), (2000, 4)):
        got = describe(df, list(columns), probs, counted)
        assert got.passes <= most
        for c, values in columns.items():
            there = np.sort(values)
            for p, q in zip(probs, got.quantiles[c]):
                x = p * (n - 1)
                lo, hi = there[math.floor(x)], there[math.ceil(x)]
                expected = lo if lo == hi else (math.ceil(x) - x) * lo + (x - math.floor(x)) * hi
                assert q == expected or abs(q - expected) <= 1e-12 * abs(expected), (c, p)
            assert math.isclose(got.means[c], values.mean(), rel_tol=1e-9)


def test_far_timestamps_change_no_forecast(spark):
    from loghawk.operators import analytics as A
    rows = [(k, f"2024-01-01 {k % 9:02d}:10:00", "Attack") for k in range(40)]
    far = [(100, "200000-01-01 00:00:00", "Attack"), (101, "0001-01-01 00:00:00", "Attack"), (102, "x", "Attack")]
    schema = "row_id long, timestamp string, predicted_label string"
    near, all_rows = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + far, schema)
    assert A.attack_forecast(near).collect() == A.attack_forecast(all_rows).collect() != []
    hours = A.hourly_attack_counts(all_rows).collect()
    assert hours == A.hourly_attack_counts(near).collect() and len(hours) == 9
    y = [r["count"] for r in sorted(hours)]
    slope, intercept = __import__("numpy").polyfit(range(9), y, 1)
    assert abs(A.attack_forecast(near).first()["forecast"] - (intercept + slope * 9)) < 1e-5
    wide = spark.createDataFrame([(k, f"{1700 + 50 * k}-01-01 00:00:00", "Attack") for k in range(6)], schema)
    assert A.hourly_attack_counts(wide).where("count > 0").count() == 6


def test_protocol_codes_follow_the_order(spark):
    names = [f"p{k:04d}" for k in range(500)] + [None]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names * 2)], "row_id long, protocol string").repartition(5)
    got = {r["protocol"]: r["protocol_encoded"] for r in P.encode_protocol(df).collect()}
    assert got == {**{n: k for k, n in enumerate(names[:-1])}, None: None}
