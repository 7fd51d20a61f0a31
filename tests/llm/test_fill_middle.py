import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghawk.llm import fill_middle
from loghawk.llm.boundary_set import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, line_boundaries
from tests.llm import cases

MARKS = ("<P>", "<S>", "<M>")


def _slow(text, key, rate=100, spm=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("values,kind", [
    ([3, 9, 70, 65535], ArrayContainer), (range(500, 40000), RunContainer),
    (sorted(random.Random(1).sample(range(65536), 9000)), BitmapContainer)])
def test_containers_select(values, kind):
    values = list(values)
    made = BoundarySet()
    for key in (0, 2, 7):
        made.append(key, np.array(values))
    made.append(8, np.array([], np.int64))
    assert all(isinstance(c, kind) for c in made.containers) and len(made) == 3 * len(values)
    expected = [(key << 16) + v for key in (0, 2, 7) for v in values]
    ks = range(len(made)) if len(made) < 100 else random.Random(2).sample(range(len(made)), 400) + [0, len(made) - 1]
    assert [made.select(k) for k in ks] == [expected[k] for k in ks]


@pytest.mark.parametrize("text", [
    "", "\n", "a", "a\n", "\na", "\n\n\n", "é\nß\n\U0001f600", "x" * 65535 + "\n" + "y", "x" * 65536, "x" * 65535 + "\n",
    "\n" * 70000, "ab\n" * 60000, "x\r\ny z\n", "".join(random.Random(3).choice("\n\nab") for _ in range(200000))])
def test_line_boundaries(text):
    made, expected = line_boundaries(text), [0]
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        expected.append(expected[-1] + len(line))
    assert len(made) == len(expected)
    ks = range(len(made)) if len(made) < 50 else random.Random(4).sample(range(len(made)), 50) + [len(made) - 1]
    assert [made.select(k) for k in ks] == [expected[k] for k in ks]


def _rows():
    extra = [(200, "has <M> inside\nb", "a"), (201, "<\nP>\nS>" * 3, "a"), (202, "<P", "a"), (203, "\n" * 9, "a"),
             (204, "<S\n>\n<\n" * 5, "b"), (205, "line\n" * 30000 + "end", "b")]
    return cases.documents() + extra + [(300 + k, "a\nbb\nccc\n" * (k % 4) + "é", "c") for k in range(60)]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 20), (0, 50), (100, 0), (100, 100)])
def test_fill_in_middle(spark, rate, spm):
    rows = _rows()
    got = fill_middle.fill_in_middle(cases.frame(spark, rows), rate=rate, spm_rate=spm) \
        .withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    cases.same_rows([r[:6] for r in got],
                    [(i, *_slow(t or "", "" if i is None else i, rate, spm)) for i, t, *_ in rows])
    cases.same_rows([(r.doc_id, r.back) for r in got], [(i, t or "") for i, t, *_ in rows])


def test_fill_in_middle_empty_table_and_text_ids(spark):
    assert fill_middle.fill_in_middle(cases.frame(spark, [])).count() == 0
    named = spark.createDataFrame([("k1", "a\nb", 1)], "id string, body string, n int")
    got = fill_middle.fill_in_middle(named, "id", "body").first()
    assert got.id == "k1" and tuple(got)[1:] == _slow("a\nb", "k1")
