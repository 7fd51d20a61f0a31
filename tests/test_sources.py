"""CSV log source and generator."""

import os
import tempfile
from datetime import datetime

import pytest

from loghawk.sources.logs import read_logs
from loghawk.sources.synthetic import synthetic_logs, write_sample_logs


def test_read_logs_file_order_and_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    header = "timestamp,source_ip,destination_ip,protocol,bytes_sent,bytes_received,connection_duration\n"
    for name, start in (("a.csv", 0), ("b.csv", 3)):
        with open(os.path.join(d, name), "w") as f:
            f.write(header)
            for i in range(start, start + 3):
                f.write(f"2024-01-01 00:00:0{i},1.1.1.{i},10.0.0.1,{'NA' if i == 4 else 'TCP'},{i},1,1\n")
    df = read_logs(spark, d).orderBy("row_id")
    got = [(r["row_id"], r["source_ip"], r["protocol"]) for r in df.collect()]
    assert [g[0] for g in got] == list(range(6))
    assert [g[1] for g in got] == [f"1.1.1.{i}" for i in range(6)]
    assert got[4][2] is None


def test_header_order_and_quoted_line_breaks(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    for name, header in (("a.csv", "timestamp,source_ip"), ("b.csv", "source_ip,timestamp")):
        with open(os.path.join(d, name), "w") as f:
            f.write(header + "\n1,2\n")
    with pytest.raises(Exception, match="CSV header|header"):
        read_logs(spark, d).collect()
    path = os.path.join(tempfile.mkdtemp(prefix="csv-", dir="/tmp"), "q.csv")
    with open(path, "w") as f:
        f.write('timestamp,source_ip\n"2024\n01",a\nx,"b ""q"""\n')
    got = read_logs(spark, path, multi_line=True).orderBy("row_id").collect()
    assert [(r["timestamp"], r["source_ip"]) for r in got] == [("2024\n01", "a"), ("x", 'b "q"')]


def test_generator_is_deterministic_and_partition_free(spark):
    start = datetime(2024, 1, 1)
    a = synthetic_logs(spark, 500, seed=42, start=start)
    b = synthetic_logs(spark, 500, seed=42, start=start).repartition(7)
    assert sorted(a.collect()) == sorted(b.collect())
    attacks = a.where("attack_type <> 'Normal'").count()
    assert attacks == int(500 * 0.22)


def test_sample_file(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="sample-", dir="/tmp"), "sample")
    write_sample_logs(spark, d, start=datetime(2024, 1, 1))
    back = read_logs(spark, d).orderBy("row_id")
    ts = [r["timestamp"] for r in back.collect()]
    assert len(ts) == 500 and ts == sorted(ts)
