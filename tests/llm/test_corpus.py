import hashlib
import json
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loghawk.llm import chat_format, kneser_ney, mixing
from loghawk.llm.html_render import html_text, parse, render_html
from tests.llm import cases


def _kneser_ney(train, texts, order):
    """(tokens, known, base, score) of each text, and the model's probability function."""
    tok = lambda t: cases.words(cases.lower(t)) + ["\n"]

    def grams(t):
        padded = ["\t"] * (order - 1) + tok(t)
        return [tuple(padded[i:i + order]) for i in range(len(tok(t)))]

    count, times = Counter(), {order: Counter()}
    for t in train:
        count.update(tok(t))
        times[order].update(grams(t))
    for k in range(order - 1, 0, -1):
        times[k] = Counter(g[1:] for g in times[k + 1])
    n, v = sum(count.values()), len(count)
    total, kinds, d = defaultdict(int), defaultdict(lambda: [0, 0, 0]), {}
    for k, table in times.items():
        of = Counter(table.values())
        d[k] = kneser_ney._discounts(*(of[i] for i in (1, 2, 3, 4)))
        for g, c in table.items():
            total[g[:-1]] += c
            kinds[g[:-1]][min(c, 3) - 1] += 1

    def p(context, w):
        k = len(context) + 1
        lower = p(context[1:], w) if context else 1 / (v + 1)
        if not total[context]:
            return lower
        c = times[k].get((*context, w), 0)
        kept = max(c - d[k][min(c, 3) - 1], 0) if c else 0
        return (kept + sum(a * x for a, x in zip(d[k], kinds[context])) * lower) / total[context]

    out = []
    for t in texts:
        w = tok(t)
        out.append((len(w), sum(count[x] > 0 for x in w), n,
                    sum(math.log10((count[x] + 1) / (n + (v + 1))) for x in w),
                    sum(math.log10(p(g[:-1], g[-1])) for g in grams(t))))
    return out, p, list(count)


@pytest.mark.parametrize("order,shard,split", [(2, 1 << 24, 1 << 20), (2, 1 << 11, 16), (3, 1 << 24, 1 << 20),
                                               (3, 1 << 11, 4), (4, 1 << 12, 16), (6, 1 << 13, 8)])
def test_kneser_ney(spark, order, shard, split):
    rows = cases.documents()
    docs = cases.frame(spark, rows)
    train = [t for i, t, _ in rows if i is None or i % 3]
    model = kneser_ney.fit(docs.where("doc_id IS NULL OR doc_id % 3 <> 0"), order=order, shard_bytes=shard,
                           split_tokens=split)
    got = kneser_ney.score(docs, model).collect()
    expected, p, known = _kneser_ney(train, [t for _, t, _ in rows], order)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3], round(r[4], 6))
    a = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    b = sorted(((i, *e) for (i, *_), e in zip(rows, expected)), key=key)
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and math.isclose(x[4], y[4], rel_tol=1e-9) and math.isclose(x[5], y[5], rel_tol=1e-9)
    assert len(a) == len(b)
    start = ("\t",) * (order - 1)
    for context in (start, (*start, known[0])[1:], (*start, known[0], known[1])[2:], (known[len(known) // 2],)):
        # a distribution over the words and the unknown one
        assert math.isclose(sum(p(context, w) for w in known) + p(context, "never seen"), 1, rel_tol=1e-9)


def test_kneser_ney_longer_contexts_predict_better(spark):
    """Held-out texts that go on as the training texts do."""
    rows = [(k, " ".join(f"w{(k * i * i + i) % 23}" for i in range(k % 11, 60 + k % 11)), "a") for k in range(120)]
    docs = cases.frame(spark, rows)
    scores = [kneser_ney.score(docs.where("doc_id % 4 = 0"), kneser_ney.fit(docs.where("doc_id % 4 <> 0"), order=n))
              .agg(F.sum("score")).first()[0] for n in (2, 3)]
    assert scores[1] > scores[0]


def test_kneser_ney_ids_of_any_width():
    """More bits than two ids in a 64-bit word leave room for: several words, sorted as the columns."""
    import numpy as np
    rng = np.random.default_rng(5)
    for bits in (1, 13, 21, 22, 32, 33, 40):
        columns = [rng.integers(0, 1 << bits, 200, dtype=np.uint64) for _ in range(4)]
        words = kneser_ney._columns_packed(columns, bits)
        assert all((a == b).all() for a, b in zip(columns, kneser_ney._columns_unpacked(words, 4, bits)))
        assert (np.lexsort(words[::-1]) == np.lexsort(columns[::-1])).all()
        merged, counts = kneser_ney._combine([np.tile(w, 2) for w in words], np.full(400, 300))
        back, times = kneser_ney._decoded(*kneser_ney._encoded(merged, counts))
        assert all((a == b).all() for a, b in zip(merged, back)) and (times == counts).all()


def test_kneser_ney_messages_are_short():
    """Three ids a gram, 24 bits each, small ones frequent: a few bytes, as each byte plane is compressed by itself."""
    import numpy as np
    rng = np.random.default_rng(6)
    n = 20_000
    ids = lambda: np.minimum(rng.zipf(1.3, n), (1 << 24) - 1).astype(np.uint64)
    words, counts = kneser_ney._combine(kneser_ney._columns_packed([ids(), ids(), ids()], 24), np.ones(n, np.int64))
    keys, times = kneser_ney._encoded(words, counts)
    assert len(keys) + len(times) < 6 * len(counts)
    for few in range(80):  # planes as long compressed as they are
        part = [w[:few] for w in words]
        back, same = kneser_ney._decoded(*kneser_ney._encoded(part, counts[:few]))
        assert all((a == b).all() for a, b in zip(part, back)) and (same == counts[:few]).all()


def test_kneser_ney_arrays_are_small(spark):
    """Less than eight bytes a gram, 16 a word, and a kilobyte a file."""
    import os
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(7)
    texts = [[f"w{i}" for i in rng.integers(0, 3000, 400)] for _ in range(150)]
    model = kneser_ney.fit(cases.frame(spark, [(i, " ".join(t), "a") for i, t in enumerate(texts)]))
    padded = [["<", "<", *t, ">"] for t in texts]
    grams = {tuple(t[i:i + 3]) for t in padded for i in range(len(t) - 2)}
    both = len(grams) + len({g[1:] for g in grams})
    sizes = [os.path.getsize(os.path.join(model.folder, f)) for f in os.listdir(model.folder)]
    assert sum(sizes) < 8 * both + 16 * model.types + 1024 * len(sizes)
    ids = kneser_ney._ids(model.folder, model.shards, np.sort(kneser_ney._tokens(pa.array(["w5 w6"]), 2)[0][2:]))
    assert (ids >= 0).all() and (ids < 1 << model.bits).all()


def test_kneser_ney_without_training(spark):
    docs = cases.frame(spark)
    got = kneser_ney.score(docs, kneser_ney.fit(docs.where("false"))).collect()
    assert len(got) == docs.count() and all(r.score == r.base_score == 0 and r.n_known == 0 for r in got)
    model = kneser_ney.fit(docs)
    assert kneser_ney.score(cases.frame(spark, []), model).count() == 0


def test_kneser_ney_beats_the_base_on_held_out_text(spark):
    rows = [(k, cases.prose(300, 50 + k % 7, 40), "a") for k in range(40)]
    model = kneser_ney.fit(cases.frame(spark, rows[:30]))
    got = kneser_ney.score(cases.frame(spark, rows[30:]), model).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be"))
    names += [None] if None in sizes else []
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        total, extra = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= cap * sizes[s]:
                extra += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free.discard(s)
        left = extra
    return target


@pytest.mark.parametrize("buckets", [1, 4, 4096])
def test_mixing(spark, buckets):
    rows = cases.documents()
    docs = cases.frame(spark, rows)
    plan = mixing.mix_plan(docs, buckets=buckets)
    got = plan.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(cases.words(t))
    target = _targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(cases.words(r.text)) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.taken for p in r.passes)
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert set(docs.columns) - {"size", "taken", "passes"} < set(plan.columns) and "size_input" in plan.columns
    again = mixing.mix_plan(docs.repartition(5), buckets=buckets)
    cases.same_rows(plan.select("doc_id", "text", "taken").collect(), again.select("doc_id", "text", "taken").collect())


def test_training_order(spark):
    docs = cases.frame(spark)
    order = mixing.training_order(mixing.mix_plan(docs)).collect()
    positions = [r.position for r in order]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert sum(r.taken for r in order) == mixing.mix_plan(docs).agg(F.sum("taken")).first()[0]
    assert mixing.training_order(mixing.mix_plan(cases.frame(spark, []))).count() == 0


@pytest.mark.parametrize("place", [0, 1, 2])
def test_due_time_inverts_the_schedule(spark, place):
    knots = mixing.SCHEDULES[place]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))

    def demand(t):
        total = 0.0
        for (a, v), (b, w) in zip(knots, knots[1:]):
            x = min(max(t - a, 0), b - a)
            total += v * x + (w - v) / (b - a) * x * x / 2
        return total / area

    got = spark.range(0, 101).select(mixing.due_time(F.lit(place), F.col("id") / 100).alias("t")).collect()
    assert all(math.isclose(demand(r.t), k / 100, abs_tol=1e-9) for k, r in enumerate(got))
    with pytest.raises(ValueError):
        mixing._segments([(0.0, 0.0), (1.0, 0.0)])


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", r"a \< b </turn> <turn>user" + "\n\\"), (1, 2, "assistant", None),
         (2, 5, "sys\ntem<", "x\n\ny"), (2, None, "assistant", "last é ß 😀"), (2, 5, "sys\ntem<", "x\n\ny"),
         (None, 0, None, "no id"), (None, 1, "assistant", "\\\\"), (3, 0, "assistant", ""), (4, 0, "user", "long " * 60000)]


def _digests(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        masked = "".join(x for *_, r, x in turns if r == "assistant")
        chars = sum(len("<turn>\n</turn>\n") + len(r) + len(x) + sum(ch in "\\<" for ch in r + x) + r.count("\n")
                    for *_, r, x in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(),
                    len(masked), hashlib.sha256(masked.encode()).hexdigest(), chars))
    return out


def _chats(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, body int")


def test_chat_round_trip(spark):
    turns = chat_format.format_turns(_chats(spark, CHATS), chat_format.text_part(F.col("text")))
    cases.same_rows(chat_format.read_back(turns).collect(), _digests(CHATS))
    assert chat_format.read_back(chat_format.format_turns(
        _chats(spark, []), chat_format.text_part(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <image> \\", None, None, None, None, None), ("image", None, 'a"b>\\c\n', 57, 28, None, None),
             ("audio", None, "s.wav", None, None, 1.5, None), ("text", "", None, None, None, None, None),
             ("document", "ignored", None, None, None, None, 3), ("text", "end", None, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)],
                                 f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = chat_format.format_turns(rows, F.col("parts")).orderBy("turn").collect()
    role, back = chat_format.parse_turn(got[0].formatted)
    assert role == "assistant" and back == [
        ("text", "see <image> \\"), ("image", 'a"b>\\c\n', 3), ("audio", "s.wav", 38), ("document", "", 1728), ("text", "end")]
    assert [tuple(a) for a in got[0].attachments] == [("image", 'a"b>\\c\n', 3), ("audio", "s.wav", 38), ("document", "", 1728)]
    assert got[0].attachment_tokens == 1769
    assert chat_format.parse_body(got[0].formatted[got[0].loss_start:got[0].loss_end]) == back
    assert got[1].formatted == "<turn>user\n</turn>\n" and got[1].loss_start == -1
    bad = spark.createDataFrame([(1, 0, "user", [("video", *[None] * 6)])], rows.schema)
    with pytest.raises(Exception, match="unknown part type"):
        chat_format.format_turns(bad, F.col("parts")).collect()
    with pytest.raises(ValueError):
        chat_format.parse_turn("<turn>user\nno end")


HTML = {
    "<p>a<p>b <b>c</b>d<ul><li>x<li>y<ol start=3><li>p<li value=9>q<li>r</ol></ul>tail":
        "a\n\nb cd\n\n- x\n- y\n  3. p\n  9. q\n  10. r\n\ntail",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1</table>after": "Name      | N\nlong name | 1\n\nafter",
    "<table><caption>C</caption><tr><td colspan=2>wide cell</td></tr><tr><td>a</td><td>b<br>c</td></tr></table>":
        "C\nwide cell\na | b\n  | c",
    "<table><td><table><tr><td>in<td>ner</table><td>out</table>": "in | ner | out",
    "a<br><br>b<pre>\n x  y\n z</pre>c": "a\n\nb\n\n x  y\n z\n\nc",
    "<div hidden>no</div><div style='color:red; DISPLAY : none'>no</div><script>var a='</p>'</script>yes &amp; &lt;b&gt;"
    "<details><summary>S</summary>body</details><details open>shown</details>": "yes & <b>\nS\nshown",
    "<head><title>no</title></head><body><!-- no --><style>p{}</style>yes<template>no</template>": "yes",
    "<blockquote>q<p>r</blockquote><dl><dt>t<dd>d</dl>": "> q\n\n> r\n\nt\n  d",
    "<h1>A</h1><div>b</div><div>c  \n d</div><hr>e": "A\n\nb\nc d\n\ne",
    "<ul><li><p>para</p><p>two</p></li><li></li><li>b</li></ul>": "- para\n\n  two\n\n- b",
    "</td></li>x<p>un<i>closed <a href='x>y'>link</a> <": "x\n\nunclosed link <",
    "plain": "plain", "": "", " \n ": "", "<div>" * 20000 + "deep": "deep", "<textarea>\n<b> x</textarea>": "<b> x",
}


@pytest.mark.parametrize("source", list(HTML), ids=range(len(HTML)))
def test_html_rendering(source):
    assert render_html(source) == HTML[source]


VISIBLE = {
    "<p class=it's>visible text, we don't lose</p>": "visible text, we don't lose",
    "<p title=5\" id=x>a 5\" b</p><a href=/x/y?q='1>c</a>'": "a 5\" b\n\nc'",
    "<p title = 'a>b' data-x=\"c>d\" hidden=>no</p><p it's>yes</p>": "yes",
    "<p>a<svg width=9><title/><style/><defs><text>no</text></defs><path d='M0'/><rect/><text x=1>One</text>"
    "<text>Two <tspan>2</tspan></text><title>no</title></svg>b": "a\nOne\nTwo 2\nb",
    "x<svg><a href=y/><text>in</text></a></svg>z": "x\nin\nz",
    "a<xmp>\n <b>x</b>  &amp;</xmp>b": "a\n\n <b>x</b>  &amp;\n\nb",
    "<a href=\"open>text": "text",
}


@pytest.mark.parametrize("source", list(VISIBLE), ids=range(len(VISIBLE)))
def test_html_emits_all_visible_text(source):
    assert render_html(source) == VISIBLE[source]


def test_html_tree():
    def shape(node):
        return [c if isinstance(c, str) else (c.tag, *shape(c)) for c in node.children]
    assert shape(parse("<table><td>1<tr><th>2</table>3")) == [
        ("table", ("tbody", ("tr", ("td", "1")), ("tr", ("th", "2")))), "3"]
    assert shape(parse("<p>a<div>b</p></div>")) == [("p", "a"), ("div", "b", ("p",))]
    assert shape(parse("<select><option>1<option>2</select>")) == [("select", ("option", "1"), ("option", "2"))]


def test_html_text(spark):
    rows = [(k, h) for k, h in enumerate(HTML)] + [(None, "<p>x"), (7, None), (7, None)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, html string, text string")
    got = html_text(pages).collect()
    cases.same_rows([(r.page_id, r.text) for r in got], [(i, HTML.get(h, "x") if h is not None else "") for i, h in rows])
    assert all(r.n_chars == len(r.text) and r.n_words == len(r.text.split()) for r in got)
    assert html_text(pages.where("false")).count() == 0


def test_attachment_digest_is_json_safe():
    assert json.loads(json.dumps(chat_format.parse_body("a\\<b"))) == [["text", "a<b"]]


def test_plan_is_range_sorted_and_null_ids_spread(spark):
    rows = [(None, cases.prose(5 + k % 9, 700 + k), "a") for k in range(300)] + [(7, cases.prose(9, 70 + k), "b") for k in range(300)]
    plan = mixing.by_position(mixing.mix_plan(cases.frame(spark, rows), carry=["doc_id"]))
    found = [r.first_position for r in plan.select("first_position").collect()]
    taken = [p for p in found if p is not None]
    assert taken == sorted(taken) and found[len(taken):] == [None] * (len(found) - len(taken)) and taken
    text = cases.frame(spark, rows).select(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "source", "text"), F.lit(mixing.BUCKETS)))
    assert text.distinct().count() > 500  # one id, or none, on half of all rows: they don't share a bucket
    whole = plan.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 for r in whole)
