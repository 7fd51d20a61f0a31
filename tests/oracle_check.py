"""Run catalog queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows (floats compared after rounding to 6 significant digits).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from loghawk.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    return con


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
    "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
}


def type_mismatches(sdf, con, sql):
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        got = duck_types.get(f.name)
        if got != want:
            out.append(f"{f.name}: spark {f.dataType.simpleString()} duck {got}")
    return out


def compare(spark, sf_dir, names=None, verbose=True, check_types=True):
    import __spark_entry__ as E
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sorted(sdf.columns)
            srows = [r.asDict(recursive=True) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in oracle:
            results[name] = f"rows-only {len(srows)}"
            print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
            continue
        try:
            ddf = con.execute(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        dcols = sorted(ddf.columns)
        if scols != dcols:
            results[name] = f"COLUMNS spark={scols} duck={dcols}"
        else:
            drecs = ddf.to_dict("records")
            a, b = rows_of(srows, scols), rows_of(drecs, dcols)
            if len(a) != len(b):
                results[name] = f"ROWCOUNT spark={len(a)} duck={len(b)}"
            elif a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                results[name] = f"VALUES differ, e.g. {diff}"
            else:
                results[name] = f"OK {len(a)} rows"
                if check_types:
                    bad = type_mismatches(sdf, con, oracle[name])
                    if bad:
                        results[name] = f"TYPES {bad}"
        print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    from loghawk.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    res = compare(get_session(), sf, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} passed")
    sys.exit(1 if bad else 0)
