import importlib
import math
import os
import random
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F

from loghawk.llm import quality_rules, secret_scan
from tests.conftest import ROOT, SF_SMALL
from tests.llm import cases
from tests.llm.test_filters import BENCH, SECRETS, _leaky, contaminated


TRUSTED = [*range(100, 140), *range(400, 407), *range(500, 507), -5]


def _tables(spark, folder):
    docs = cases.frame(spark, _leaky() + SECRETS).drop("size", "taken", "position", "passes", "copy", "kept")
    docs = docs.withColumn("n_chars", F.length("text").cast("int"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in TRUSTED] + [(12, 0, 0), (14, 1, 1), (None, 1, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


_M = (1 << 64) - 1


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M
    return x ^ x >> 31


def _gram_buckets(words, buckets=1 << 13):
    hashes = []
    for w in words:
        raw = w.encode()
        hashes.append(_mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(raw)) & _M))
    pairs = [_mix((a + b * 0xD1342543DE82EF95) & _M) for a, b in zip(hashes, hashes[1:])]
    return Counter(h % buckets for h in hashes + pairs)


def _quality_kept(rows, trusted, buckets=1 << 13):
    """Whether each (doc_id, text) is kept, each distinct text counted once, in plain Python."""
    keys = [tuple(cases.words(cases.lower(t))) for _, t in rows]
    good = {k for (i, _), k in zip(rows, keys) if i in trusted}
    grams = {k: _gram_buckets(k) for k in set(keys)}
    raw, target = Counter(), Counter()
    for k, g in grams.items():
        raw.update(g)
        if k in good:
            target.update(g)
    total, wanted, out = sum(raw.values()), sum(target.values()), []
    for (_, text), k in zip(rows, keys):
        own, n = grams[k], sum(grams[k].values())
        score = 0.0
        for b, times in own.items():
            p = (raw[b] - times + 1) / (total - n + buckets)
            score += times * math.log((target[b] + buckets * p) / (wanted + buckets) / p)
        out.append(not cases.quality_base(text)[5] and score / max(n, 1) >= -0.05)
    return out


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    docs = _tables(spark, str(tmp_path))
    out = {}
    for name, stage in P.STAGES:
        got = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        got.write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination",
                                        "secret_scans", "mixing"]
    for name in list(out)[:-1]:
        assert out[name][1].columns == out[name][0].columns

    before, after = out["quality_rules"]
    rows = before.collect()
    kept = _quality_kept([(r.doc_id, r.text) for r in rows], set(TRUSTED))
    assert sorted(repr(r) for r, keep in zip(rows, kept) if keep) == _rows(after)

    before, after = out["simhash_near_dedup"]
    rows = before.collect()
    group = cases.components([cases.fingerprint(r.text) for r in rows])
    best = {}
    for r, g in zip(rows, group):
        best[g] = min(best.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in after.collect()) == sorted(best.values())

    before, after = out["benchmark_decontamination"]
    leaked = {i for i, _ in contaminated([(r.doc_id, r.text) for r in before.collect()], BENCH)}
    assert leaked and {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == leaked

    before, after = out["secret_scans"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in before.collect()) == \
        sorted((r.doc_id is None, r.doc_id or 0) for r in after.collect())
    assert secret_scan.scan(after).where("n_assign + n_access + n_hex > 0").count() == 0
    same = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert (secret_scan.MASK in r.text) == (r.text != same[r.doc_id]) and r.n_chars == len(r.text)

    _, order = out["mixing"]
    assert {"position", "copy", "taken"} < set(order.columns) and order.count() >= after.where("n_chars > 0").count() / 2


def test_a_text_that_is_a_third_of_all_rows_stays(spark, tmp_path):
    """Copies of a clean text, labelled or not, aren't held against it, and one of them is left after near-dedup."""
    import corpus_pipeline as P
    names = sorted(set(cases.prose(200, 900, 20).split()))
    clean = [(k, " ".join(random.Random(k).choices(names, k=200)), "a") for k in range(40)]
    copies = [(1000 + k, clean[39][1], "b") for k in range(20)] + [(2000 + k, clean[0][1], "b") for k in range(20)]
    junk = [(3000 + k, "buy now " * 30 + cases.prose(60, 5000 + k, 3000), "c") for k in range(10)]
    rows = clean + copies + junk
    cases.frame(spark, rows).select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(35)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = P.quality_stage(spark, docs, str(tmp_path))
    kept = _quality_kept([(i, t) for i, t, _ in rows], set(range(35)))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r[0] for r, keep in zip(rows, kept) if keep)
    assert {r[0] for r in clean + copies} <= {r.doc_id for r in after.collect()}
    left = {r.doc_id for r in P.near_dedup_stage(spark, after, str(tmp_path)).collect()}
    assert {r[0] for r in clean} <= left and not left & {r[0] for r in copies}


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P
    docs = cases.frame(spark, []).select("doc_id", "text", "source", F.length("text").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0 and set(docs.columns) <= set(got.columns), name
    assert quality_rules.quality_report(docs, quality_rules.fit_distinct(docs, docs.select("doc_id"))).count() == 0
    assert secret_scan.redact(docs).count() == 0


def test_run_writes_and_rereads_every_stage(spark):
    import corpus_pipeline as P
    got = P.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert set(docs.columns) < set(got.columns) and 0 < got.select("doc_id").distinct().count() <= docs.count()
    assert got.select("doc_id").exceptAll(got.select("doc_id")).count() == 0


def test_entry_without_the_folder(tmp_path):
    """The rest imports and registers its queries when the folder and the pipeline are gone."""
    for name in os.listdir(ROOT):
        if name in ("loghawk", ".git", "corpus_pipeline.py"):
            continue
        os.symlink(os.path.join(ROOT, name), tmp_path / name)
    (tmp_path / "loghawk").mkdir()
    for name in os.listdir(os.path.join(ROOT, "loghawk")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "loghawk", name), tmp_path / "loghawk" / name)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'pipeline' not in q and len(q) > 50; print('ok')"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "ok", done.stderr[-500:]


def test_fourteen_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    import loghawk.plans.catalog as catalog
    assert not any(n.startswith("op") and n[2].isdigit() for n in catalog.QUERIES)
