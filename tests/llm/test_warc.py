import gzip
import hashlib
import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loghawk.llm import warc
from tests.llm import cases

SCHEMA = "page_id long, url string, html string, shard int, digest string, refers_to int, is_page int, name string"


def _pages():
    r = random.Random(5)
    common = "<p>not found</p>"
    rows = [(k, f"https://h{k % 7}.example/p?q={k}", common if k % 3 == 0 else f"<p>{cases.prose(r.randint(1, 300), k)}</p>")
            for k in range(300)]
    rows += [(1000, None, None), (1001, "u", ""), (999, "http://a b\r\nX: y", ""), (None, "n", common), (None, "n", "only here"),
             (None, "m", "twice"), (None, "l", "twice"), (-4, "é", "é ß \U0001f600\r\n\r\nWARC/1.1\r\n"), (2000, "v", "same"),
             (2000, "v", "same"), (2000, "w", "same"), (2000, "w", "other"), (3000, "long", "x" * 3_000_000), (3001, "long", "é" * 500_000)]
    return rows


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(*x, 1, "d", 2, 3, "n") for x in rows], SCHEMA).repartition(parts)


def _expected(rows, least=0):
    import base64
    groups = {}
    for k, (i, u, h) in enumerate(rows):
        groups.setdefault((h or "").encode(), []).append(((i is None, i or 0, u is None, u or ""), k))
    out = []
    for payload, members in groups.items():
        members.sort()
        first = rows[members[0][1]][0]
        for n, (_, k) in enumerate(members):
            again = n > 0 and len(payload) >= least
            out.append((rows[k][0], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                        "revisit" if again else "response", first if again else None))
    return out


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least,shard,file", [(0, 64 << 20, 16 << 20), (0, 20_000, 4_000), (8, 50_000, 1), (10 ** 9, 9_000, 10 ** 9)])
def test_warc_round_trip(spark, tmp_path, least, shard, file):
    rows, folder = _pages(), f"file://{tmp_path}/a"
    made = warc.write_warc(_frame(spark, rows), folder, least=least, shard_bytes=shard, file_bytes=file).collect()
    back = warc.read_warc(spark, folder).collect()
    cases.same_rows([tuple(r[c] for c in COLUMNS) for r in back], _expected(rows, least))
    texts = {hashlib.sha1((h or "").encode()).digest(): (h or "").encode() for _, _, h in rows}
    responses = {r.record_id: r for r in back if r.record_type == "response"}
    assert len({r.record_id for r in back}) == len(back)
    for r in back:
        if r.record_type == "response":
            assert texts[hashlib.sha1(r.payload).digest()] == bytes(r.payload)
        else:
            assert r.payload is None and responses[r.refers_to_record].payload_digest == r.payload_digest
            assert responses[r.refers_to_record].page_id == r.refers_to
    # The manifest names the files that are there, their sizes and digests; shards hold ascending ranges.
    assert sorted(os.listdir(tmp_path / "a")) == sorted([*(m.name for m in made), "manifest"])
    for m in made:
        raw = (tmp_path / "a" / m.name).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (m.bytes, m.sha256)
    order = [i for m in sorted(made, key=lambda m: m.name) for i in (m.first_page, m.last_page)]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))
    assert sum(m.records for m in made) == len(rows) and (shard > 10 ** 6 or len({m.shard for m in made}) > 3)


def test_warc_same_files_from_any_partitions(spark, tmp_path):
    rows = _pages()
    made = []
    for n, parts in enumerate((1, 7)):
        random.Random(n).shuffle(rows)
        made.append(warc.write_warc(_frame(spark, rows, parts), f"file://{tmp_path}/{n}", shard_bytes=30_000, file_bytes=9_000))
    cases.same_rows(made[0].collect(), made[1].collect())


def test_warc_hot_payloads_join_by_broadcast(spark, tmp_path, monkeypatch):
    rows = [(k, "u", f"copy {k % 5}" if k % 2 else f"own {k}") for k in range(400)]
    monkeypatch.setattr(warc, "HOT_SHARE", 10)  # the five common payloads are hot
    warc.write_warc(_frame(spark, rows), f"file://{tmp_path}/a", shard_bytes=10_000)
    cases.same_rows(warc.read_warc(spark, f"file://{tmp_path}/a", payload=False).select(*COLUMNS).collect(), _expected(rows))


def test_warc_is_all_or_nothing(spark, tmp_path):
    rows, folder = _pages()[:40], f"file://{tmp_path}/a"
    # What a failed run leaves: a finished file without a manifest, and files of a lost attempt.
    os.makedirs(tmp_path / "a" / "_attempt-lost" / "data")
    (tmp_path / "a" / "shard-00000-000.warc.gz").write_bytes(b"half")
    with pytest.raises(Exception):
        warc.read_warc(spark, folder)
    warc.write_warc(_frame(spark, rows), folder)
    cases.same_rows(warc.read_warc(spark, folder).select(*COLUMNS).collect(), _expected(rows))
    before = (tmp_path / "a" / "shard-00000-000.warc.gz").read_bytes()
    with pytest.raises(ValueError, match="already holds"):
        warc.write_warc(_frame(spark, rows[:3]), folder)
    assert (tmp_path / "a" / "shard-00000-000.warc.gz").read_bytes() == before


def test_warc_two_attempts_of_a_task_keep_apart(tmp_path):
    rows = [(0, 1, b"d" * 20, 1, None, "u", "text")]
    batch = warc._batch(rows, "shard int, page_id long, digest binary, is_page int, refers_to long, url string, html string")
    first, second = (next(warc._write_shards([batch], f"file://{tmp_path}", 1 << 20, 6)).to_pylist()[0] for _ in range(2))
    assert first["temporary"] != second["temporary"] and first["sha256"] == second["sha256"]


def test_warc_empty_table(spark, tmp_path):
    assert warc.write_warc(_frame(spark, []), f"file://{tmp_path}/a").count() == 0
    assert warc.read_warc(spark, f"file://{tmp_path}/a").count() == 0


def test_warc_headers_and_damage(spark, tmp_path):
    warc.write_warc(_frame(spark, [(999, "http://a b\r\nX: y", "body"), (1001, "u", "body")]), f"file://{tmp_path}/a")
    raw = (tmp_path / "a" / "shard-00000-000.warc.gz").read_bytes()
    text = gzip.decompress(raw).decode()
    assert "WARC-Target-URI: http://a%20b%0D%0AX:%20y\r\n" in text
    assert re.findall(r"WARC-Type: (\w+)", text) == ["warcinfo", "response", "revisit"]
    assert len(list(warc.records(io.BytesIO(raw), True))) == 2
    for damaged in (text.replace("body", "bodx"), text.replace("X-Payload-Length: 4", "X-Payload-Length: 5"),
                    text.replace("\r\n\r\nbody", "\r\n\r\nbod"), text[:-30]):
        with pytest.raises((ValueError, KeyError)):
            list(warc.records(io.BytesIO(gzip.compress(damaged.encode())), True))


def test_warc_of_other_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "x")], "k int, link string, body string")
    warc.write_warc(rows, f"file://{tmp_path}/a", "k", "link", "body")
    assert warc.read_warc(spark, f"file://{tmp_path}/a").select("page_id", F.decode("payload", "utf-8")).first()[:] == (1, "x")
