"""Scan store: replace, delete, empty tables, pruned reads."""

import tempfile

import pytest
from pyspark.sql import functions as F

from loghawk.operators import history as H
from loghawk.operators import incidents as I
from loghawk.operators import scoring as T
from loghawk.plans.fixture_plans import scored_fixture
from loghawk.sources.store import ScanStore
from tests.conftest import SF_SMALL


def _store(spark):
    return ScanStore(spark, tempfile.mkdtemp(prefix="store-", dir="/tmp"))


def test_write_delete_write(spark):
    store = _store(spark)
    scored = scored_fixture(spark, SF_SMALL)
    n = scored.count()
    for scan in (1, 2):
        store.write_scan(scan, 7, f"s{scan}.csv", T.scan_metrics(scored), f"2024-01-0{scan} 00:00:00")
        store.write_events(scan, scored)
    store.write_scan(1, 7, "s1.csv", T.scan_metrics(scored), "2024-01-01 00:00:00")  # again: one row
    store.write_events(1, scored)
    assert store.scans().count() == 2 and store.events().count() == 2 * n
    assert [r["id"] for r in H.scans_for_user(store.scans(), 7).collect()] == [2, 1]
    assert H.scan_report(store.scans()).where("id = 1").first()["total_logs"] == n
    store.delete_scan(1)
    assert store.events().select("scan_id").distinct().collect() == [(2,)] and store.scans().count() == 1
    store.write_events(1, scored)
    assert store.events().where("scan_id = 1").count() == n
    store.delete_scans(spark.createDataFrame([(1,), (99,)], "scan_id bigint"))
    assert store.scan_ids() == [2] and store.next_id("scans") == 3


def test_rerun_without_rows_leaves_none(spark):
    store = _store(spark)
    scored = scored_fixture(spark, SF_SMALL)
    rows = I.incident_rows_for_store(I.incident_records(scored, 1, year=2024), 1)
    store.write_incidents(1, rows)
    assert store.incidents().count() == rows.count() > 0
    store.write_incidents(1, rows.where("false"))
    store.write_events(1, scored)
    store.write_events(1, scored.where("false"))
    assert store.incidents().count() == 0 and store.events().count() == 0


def test_new_store_is_empty(spark):
    store = _store(spark)
    assert [t.count() for t in (store.scans(), store.events(), store.incidents(), store.audit())] == [0] * 4
    assert store.next_id("audit_log") == 1 and store.scan_ids() == []
    store.delete_scan(5)


def test_one_scan_reads_one_folder(spark):
    store = _store(spark)
    scored = scored_fixture(spark, SF_SMALL).withColumn("scan_id", F.col("row_id") % 3)
    store.write_event_table(scored)
    assert store.scan_ids() == [0, 1, 2] and store.events().count() == scored.count()
    plan = H.events_for_scan(store.events(), 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(scan_id" in plan and "(scan_id" in plan.split("PartitionFilters")[1]


def _scan(store, spark, scan, scored):
    with store.transaction() as tx:
        tx.write_events(scan, scored)
        tx.write_incidents(scan, I.incident_rows_for_store(I.incident_records(scored, scan, year=2024), scan))
        tx.write_scan(scan, 7, f"s{scan}.csv", T.scan_metrics(scored), "2024-01-01 00:00:00")


def _state(store):
    return [sorted(map(repr, t.drop("created_at").collect())) for t in (store.scans(), store.events(), store.incidents())]


def test_failure_between_two_writes_leaves_the_old_scan(spark):
    store, scored = _store(spark), scored_fixture(spark, SF_SMALL)
    _scan(store, spark, 1, scored)
    before = _state(store)
    with pytest.raises(RuntimeError):
        with store.transaction() as tx:
            tx.write_events(1, scored.where("false"))
            raise RuntimeError("lost")
    assert _state(store) == before and store.recover() == 0


@pytest.mark.parametrize("lost_at", [1, 2, 3, 4, 5])
def test_publication_is_finished_after_a_loss(spark, monkeypatch, lost_at):
    """A writer lost between any two renames: the next one finishes, and all tables show the new scan."""
    store, scored = _store(spark), scored_fixture(spark, SF_SMALL)
    _scan(store, spark, 1, scored)
    calls, move = [], ScanStore._move

    def breaks(self, old, new):
        calls.append(old)
        if len(calls) == lost_at:
            raise OSError("lost")
        move(self, old, new)

    monkeypatch.setattr(ScanStore, "_move", breaks)
    few = scored.where("row_id % 2 = 0")
    with pytest.raises(OSError):
        _scan(store, spark, 1, few)
    monkeypatch.setattr(ScanStore, "_move", move)
    assert store.recover() == 1 and store.recover() == 0
    assert store.events().count() == few.count() and H.scan_report(store.scans()).first()["total_logs"] == few.count()


def test_two_writers_never_get_one_id(spark):
    from concurrent.futures import ThreadPoolExecutor
    store = _store(spark)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: ScanStore(spark, store.root).next_id("scans"), range(24)))
    assert sorted(got) == list(range(1, 25))


def test_a_large_scan_is_written_by_many_tasks(spark):
    import glob
    store = _store(spark)
    scored = scored_fixture(spark, SF_SMALL)
    n = scored.count()
    events = scored.withColumn("scan_id", F.when(F.col("row_id") % 3 == 0, 0).otherwise(F.col("row_id") % 7 + 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        store.write_event_table(events, file_rows=n // 30)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{store.root}/scan_events/scan_id=0/*.parquet")) > 1
    assert sorted(map(repr, store.events().collect())) == sorted(map(repr, events.select(*store.events().columns).collect()))
    assert H.events_for_scan(store.events(), 0).count() == events.where("scan_id = 0").count()


def test_compacted_scans(spark):
    import glob
    store = _store(spark)
    schema = "total_logs long, attack_count long, critical_count long"
    for scan in (1, 2, 3):
        store.write_scan(scan, 7, f"s{scan}.csv", spark.createDataFrame([(scan, 1, 0)], schema), "2024-01-01 00:00:00")
    before = sorted(map(repr, store.scans().collect()))
    store.compact_scans()
    assert store.scan_ids("scans") == [] and sorted(map(repr, store.scans().collect())) == before
    assert len(glob.glob(f"{store.root}/scans_base/*.parquet")) == 1
    store.write_scan(2, 8, "again.csv", spark.createDataFrame([(20, 1, 0)], schema), "2024-01-01 00:00:00")
    store.delete_scan(3)
    assert sorted((r["id"], r["total_logs"]) for r in store.scans().collect()) == [(1, 1), (2, 20)]
    store.compact_scans()
    assert sorted((r["id"], r["total_logs"]) for r in store.scans().collect()) == [(1, 1), (2, 20)]
    assert store.scan_ids("scans") == [] and store.next_id("scans") == 3


def test_rollups_follow_the_rows(spark):
    """Rows stored again, a scan without attacks, null addresses and unparsable times."""
    from loghawk.operators import analytics as A
    from loghawk.operators import rollups as R
    store = _store(spark)
    assert R.kpi_row(store.hours()).first()["total_logs"] == 0 and R.top_source_ips(store.addresses()).count() == 0
    scored = scored_fixture(spark, SF_SMALL)
    odd = scored.withColumns({"timestamp": F.when(F.col("row_id") % 5 == 0, "never").otherwise(F.col("timestamp")),
                              "source_ip": F.when(F.col("row_id") % 3 > 0, F.col("source_ip"))})
    events = odd.withColumn("scan_id", F.col("row_id") % 4)
    store.write_event_table(events)
    for name in ("kpi_row", "attack_timeline", "severity_distribution", "attack_type_breakdown", "attack_heatmap",
                 "hourly_attack_counts", "attack_forecast"):
        assert sorted(map(str, getattr(R, name)(store.hours()).collect())) == \
            sorted(map(str, getattr(A, name)(store.events()).collect())), name
    assert R.top_source_ips(store.addresses()).collect() == A.top_source_ips(store.events()).collect()
    assert R.top_source_ips(store.addresses()).first()["source_ip"] is None
    store.write_events(1, odd.where("predicted_label = 'Normal'"))
    store.write_event_table(events.where("scan_id = 2 AND predicted_label = 'Normal'"))
    assert store.addresses().where("scan_id IN (1, 2)").count() == 0 and store.addresses().count() > 0
    assert R.kpi_row(store.hours()).first() == A.kpi_row(store.events()).first()
