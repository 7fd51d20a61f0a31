"""End-to-end scan: sample CSV -> stored scan, events, incidents, audit."""

import os
import tempfile
from datetime import datetime

from loghawk.operators import analytics as A
from loghawk.operators import history as H
from loghawk.operators import rollups as R
from loghawk.plans.scan import run_scan
from loghawk.plans.scan_models import load_scan_models
from loghawk.sources.store import ScanStore
from loghawk.sources.synthetic import write_sample_logs


def test_run_scan_end_to_end(spark):
    base = tempfile.mkdtemp(prefix="scan-", dir="/tmp")
    csv = os.path.join(base, "sample")
    write_sample_logs(spark, csv, n_rows=500, seed=42, start=datetime(2024, 6, 1))
    store = ScanStore(spark, os.path.join(base, "store"))
    scan = run_scan(spark, csv, store, scan_id=1, user_id=7, dataset_name="sample.csv", year=2024,
                    scan_date="2024-06-02 00:00:00", rf_trees=10, rf_depth=5, gbt_rounds=5, gbt_depth=3,
                    iso_trees=20)
    assert scan.result is not None
    assert store.events().count() == scan.result.scored.count()
    report = H.scan_report(store.scans()).first()
    assert report["total_logs"] == 500 - scan.quality.first()["duplicates_removed"]
    assert report["classification_classes"] == scan.result.class_names
    assert store.audit().first()["details"] == "Scan #1 on sample.csv"
    assert store.incidents().count() == scan.incidents.count()
    saved = load_scan_models(store.models_path(1))
    assert saved.class_names == scan.result.class_names and set(saved.models) == set(scan.result.models)
    assert R.kpi_row(store.hours()).first() == A.kpi_row(store.events()).first()
    store.delete_scan(1)
    assert store.hours().count() == store.addresses().count() == 0 and not os.path.exists(store.models_path(1))


def test_run_scan_rejects_missing_columns(spark):
    base = tempfile.mkdtemp(prefix="scan-", dir="/tmp")
    path = os.path.join(base, "bad.csv")
    with open(path, "w") as f:
        f.write("timestamp,source_ip\n2024-01-01 00:00:00,1.1.1.1\n")
    scan = run_scan(spark, path, ScanStore(spark, os.path.join(base, "store")), 1, 1, "bad.csv")
    assert scan.result is None
    assert scan.issues[0].startswith("Required columns not in the file: destination_ip, protocol")
