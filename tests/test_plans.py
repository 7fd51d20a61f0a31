"""Physical plan shape of the scale-sensitive operators."""

from loghawk.operators import analytics as A
from loghawk.operators import history as H
from loghawk.operators import incidents as I
from loghawk.operators import prepare as P
from loghawk.plans.fixture_plans import scored_fixture
from loghawk.sources import fixtures
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_lists_limit_before_shuffle(spark):
    scored = scored_fixture(spark, SF_SMALL)
    p = plan(I.smallest_distinct(scored, ["attack_type_predicted", "severity"], {"destination_ip": ("a", "n")}, 10))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "WindowGroupLimit" in plan(H.user_recent_scans(fixtures.scans(spark, SF_SMALL)))


def test_top_k_is_bounded_heap(spark):
    scored = scored_fixture(spark, SF_SMALL)
    for q in (A.top_source_ips(scored), A.top_scored_events(scored), A.traffic_sample(scored)):
        assert "TakeOrderedAndProject" in plan(q)


def test_stored_scores_are_pruned_and_filtered_in_the_scan(spark):
    stored = P.cut_lineage(scored_fixture(spark, SF_SMALL))
    scan = [line for line in plan(A.kpi_row(stored)).splitlines() if "FileScan" in line][0]
    read = scan.split("ReadSchema: ")[1]
    assert "source_ip" not in read and "bytes_sent" not in read and "predicted_label" in read
    scan = [line for line in plan(A.top_source_ips(stored)).splitlines() if "FileScan" in line][0]
    assert "EqualTo(predicted_label,Attack)" in scan and "threat_score" not in scan.split("ReadSchema: ")[1]


def test_incidents_store_nothing_and_share_the_distinct_addresses(spark, monkeypatch):
    import loghawk.operators.prepare as prepare
    stored = P.cut_lineage(scored_fixture(spark, SF_SMALL))
    monkeypatch.setattr(prepare, "cut_lineage", None)
    df = I.incident_records(stored, 1, year=2024)
    df.collect()
    p = plan(df)
    assert "isFinalPlan=true" in p and "ReusedExchange" in p
    final = p.split("== Initial Plan ==")[0]
    assert len([line for line in final.splitlines() if "FileScan" in line]) == 2  # totals, addresses
    pairs = [line for line in final.splitlines() if "source_ip" in line and "destination_ip" in line and "HashAggregate" in line]
    assert not pairs  # no aggregate over (source, destination)


def test_no_percentile_aggregate_in_the_cleaning(spark):
    for df in (P.fill_median(P.coerce_numeric(fixtures.security_logs(spark, SF_SMALL))),
               P.clean_logs(fixtures.security_logs(spark, SF_SMALL))):
        assert "percentile(" not in df._jdf.queryExecution().toString()


def test_dedup_aggregates_partially_before_shuffle(spark):
    p = plan(P.dedup_first(P.coerce_numeric(fixtures.security_logs(spark, SF_SMALL))))
    lines = p.splitlines()
    ex = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(timestamp" in line]
    assert ex and any("Aggregate" in line for line in lines[ex[0] + 1:])


def test_global_statistics_are_no_joins(spark):
    df = P.scale_features(P.fill_median(P.coerce_numeric(fixtures.security_logs(spark, SF_SMALL))))
    p = plan(df)
    assert "Join" not in p and "CartesianProduct" not in p


def test_anomaly_fixture_flags_a_tenth(spark):
    scored = scored_fixture(spark, SF_SMALL)
    n, flagged = scored.count(), scored.where("is_anomaly").count()
    assert 0.05 * n <= flagged <= 0.15 * n and A.top_anomalies(scored).count() == 20


def test_store_reads_prune_partitions(spark, tmp_path):
    from loghawk.sources.store import ScanStore
    store = ScanStore(spark, str(tmp_path / "store"))
    scored = scored_fixture(spark, SF_SMALL)
    store.write_events(1, scored)
    store.write_events(2, scored)
    p = plan(store.events().where("scan_id = 2"))
    assert "PartitionFilters: [isnotnull(scan_id" in p and "(scan_id" in p
