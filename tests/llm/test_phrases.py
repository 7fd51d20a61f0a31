import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghawk.llm import phrases
from tests.llm import cases

SCHEMA = "doc_id long, text string, lang string, gram int, f string, n int, bucket int, piece string"


def _slow(rows, least, absorb=100, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", cases.lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for size in range(1, 6):
                counts[lang].update(tuple(ws[i:i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = {}
        for g, a in cand.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        longer[g[i:j]] = max(longer.get(g[i:j], 0), a)
        kept = []
        for g, a in cand.items():
            if 100 * longer.get(g, -1) >= absorb * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def _rows():
    r = random.Random(11)
    vocabulary = ["w%d" % k for k in range(30)] + ["É", "ß", "\U0001f600", "a-b", "#x"]
    line = "This license, which is granted to all users of the work; free of any charge!"
    rows = [(k, " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", "\n", "\t", " ?", "\x0b"]) for _ in range(r.randint(0, 120))),
             r.choice(["en", "de", None, "und", ""])) for k in range(150)]
    rows += [(500 + k, "Copied " + line + " " + line.upper(), "en") for k in range(12)]
    rows += [(600, "x y " * 700, "en"), (601, "of the " * 500 + "end", "de"), (602, "a " * 900, "de"), (None, None, None), (603, "", "en"),
             (604, " .,; ", "en"), (600, "x y " * 700, "en"), (605, "one", "solo")]
    # A pair that a third of all grams begin with.
    rows += [(700 + k, " ".join(f"of the {r.choice(vocabulary)} {r.choice(vocabulary)}" for _ in range(60)), "en") for k in range(20)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "f", 2, 3, "p") for x in rows], SCHEMA).repartition(4)


def _got(df):
    return [tuple(r)[:8] for r in df.collect()]


@pytest.mark.parametrize("least,absorb,top,parts", [
    (3, 100, 2000, {}), (3, 100, 50, {"bucket_grams": 200, "share": 20}), (2, 60, 2000, {"bucket_grams": 100, "share": 40}),
    (12, 100, 7, {"bucket_grams": 1 << 30}), (5, 30, 2000, {"dictionary_words": 0}), (10 ** 6, 100, 10, {})])
def test_collocations(spark, least, absorb, top, parts):
    rows = _rows()
    got = phrases.collocations(_frame(spark, rows), least=least, absorb=absorb, top=top, **parts)
    cases.same_rows(_got(got), _slow(rows, least, absorb, top))


def test_collocations_through_groups_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FAN", 5)
    monkeypatch.setattr(phrases, "SAMPLE_WORDS", 3000)
    rows = _rows()
    got = phrases.collocations(_frame(spark, rows), least=4, bucket_grams=150, share=30)
    cases.same_rows(_got(got), _slow(rows, 4))


def test_common_prefixes_are_dealt_further(spark):
    rows = _rows()
    docs = _frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary, seed = phrases._vocabulary(docs)
    table = vocabulary.where("n >= 2").toArrow()
    known = phrases._Dictionary(table)
    common = phrases._common_prefixes(docs, seed, spark.sparkContext.broadcast(known), 1000, 20)
    sizes = {size: len(found) for size, found in common.by_size.items()}
    assert 0 < sizes[2] < 20
    number = {(lang, word): k + 1 for k, (lang, word) in enumerate(zip(known.langs.to_pylist(), known.words.to_pylist()))}
    pair = np.uint64(number["en", "of"] << phrases.BITS | number["en", "the"])
    lo = np.arange(1, 30, dtype=np.uint64) << np.uint64(2 * phrases.BITS)
    assert len(np.unique(common.deal(np.full(29, pair), lo))) == 29
    assert len(np.unique(phrases._Common([]).deal(np.full(29, pair), lo))) == 1


def test_long_texts_and_scores_beyond_64_bits(spark):
    text = "ab cd ef gh " * 400_000 + "zz"  # 4.8 MB without a break
    rows = [(1, text, "en"), (2, "ab cd, ef gh\n" * 50, "en")]
    cases.same_rows(_got(phrases.collocations(_frame(spark, rows), least=20)), _slow(rows, 20))
    big = 3_000_000_000_000
    made = spark.createDataFrame([("en", ["a", "b"], big - 1)], "lang string, gram array<string>, f long")
    words = spark.createDataFrame([("en", ["a"], big), ("en", ["b"], big + 7)], made.schema)
    got = phrases.cut_scores(made, words, spark.createDataFrame([("en", 9 * big)], "lang string, n long")).first()
    assert got.score == 1000 * (big - 1) * 9 * big // (big * (big + 7)) and got.k == 1


def test_chunks_cut_between_words():
    data = np.frombuffer(b"aa bb  cc. dd ee ff gg hh" * 30 + b"x" * 300 + b" tail", np.uint8)
    parts = list(phrases._chunks(data, 64))
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    for _, end, ahead in parts:
        assert end == len(data) or data[end] in b" .,"
        assert len(bytes(data[end:ahead]).replace(b".", b" ").split()) == 4 or ahead == len(data)


def test_vocabulary_changes_its_seed_on_a_collision(spark, monkeypatch):
    docs = _frame(spark, [(1, "a b a", "en")]).select("lang", "text")
    found, seed = phrases._vocabulary(docs)
    assert seed == 0 and sorted((r.word, r.n) for r in found.collect()) == [("a", 2), ("b", 1)]


def test_collocations_without_rows(spark):
    assert phrases.collocations(_frame(spark, [])).count() == 0
    assert phrases.collocations(_frame(spark, [(1, None, None)]), least=1).count() == 0
