"""Secret scan with DataFrame functions: fixed patterns plus windowed entropy.

Pattern kinds (leftmost, non-overlapping, each on its own): ``assign``, ``access``,
``hex``. The entropy kind takes candidate strings, one character class at a time,
and slides a window over each: the window's Shannon entropy follows from counts
that change by the character that enters and the one that leaves, and the state
folds along the string. Windows at or above the class's threshold merge into spans.
Allow-listed words (example words, runs of an alphabet) end a candidate: what stands
beside them is judged on its own. Allow-listed candidates give none: pure repeats,
letters of one case, and paths or identifiers, whose parts between separators are
capitalised words, or one case throughout, with one digit at the end at most.

Positions are in characters (code points), ends exclusive. Spark's regular
expressions give texts, not positions: the lengths of the pieces around the
matches (``split`` by the same pattern) add up to them.

Edge cases: a null text is empty and has no span; texts without a match have empty
lists; repeated rows are scanned each; extra columns are carried by ``redact`` and
ignored by ``scan``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghawk.llm.text import free_name

#: Fixed pattern kinds in their order: kind -> (pattern, group whose length counts, least length).
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Entropy classes: class -> (candidate, alphabet, window, least bits a character).
CLASSES = {
    "hexadecimal": (r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", "0123456789abcdef", 20, 3.0),
    "base64": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}",
               "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 20, 3.7),
}
#: Words that are no part of a secret; candidates are what is left between them.
WORDS = ["example", "placeholder", "changeme", "abcdefghij", "0123456789"]
_PART = r"(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+|[A-Z]++)[0-9]?+"
#: Candidates that are no secrets.
ALLOWED = [
    r"^[a-z_/-]+$", r"^[A-Z_/-]+$", rf"^[-_/+]*+{_PART}(?:[-_/+]++{_PART})*+[-_/+]*+$", r"^[0-9]+$",
    r"^(.{1,4})\1{3,}$", "(?i)" + "|".join(WORDS),
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
]
KIND_ORDER = [*KINDS, "entropy"]
MASK = "[SECRET]"
_NONE = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once even where lambdas in the body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """The list in runs of about the square root of its length: folds that append stay short."""
    def cut(items):
        each = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))), F.lit(1)).cast("int")
        runs = F.ceil(F.size(items) / each).cast("int")
        return F.when(F.size(items) <= 16, F.array(items)).otherwise(
            F.transform(F.sequence(F.lit(0), runs - 1), lambda k: F.slice(items, k * each + 1, each)))

    return _let(items, cut)


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, match) of every match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(acc, pair):
        start = acc["at"] + pair["before"]
        end = start + F.length(pair["match"])
        row = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def start_of_next(acc, block):
        size = F.aggregate(block, F.lit(0), lambda n, pair: n + pair["before"] + F.length(pair["match"]))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    blocks = _blocks(F.zip_with(before, found, lambda b, m: F.struct(b.alias("before"), m.alias("match"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def all_placed(blocks):
        return F.flatten(F.zip_with(blocks, F.aggregate(blocks, none, start_of_next, lambda acc: acc["out"]), placed))

    # Only texts with a match are split and folded.
    return F.when(text.rlike(pattern), _let(blocks, all_placed)).otherwise(empty)


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KIND_ORDER.index(kind)).alias("kind"),
                    end.cast("int").alias("end"))


def _pattern_spans(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]

    def long_enough(m):
        return F.length(F.regexp_extract(m["match"], pattern, group) if group else m["match"]) >= least

    return F.transform(F.filter(_matches(text, pattern), long_enough), lambda m: _span(m["start"], kind, m["end"]))


def _xlogx(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _entropy_windows(match: Column, alphabet: str, window: int, bits: float) -> Column:
    """Merged (start, end) of the windows with at least ``bits`` a character, counted from the match's start.

    With counts c of a window of w characters the entropy is log2(w) - sum(c log2 c) / w.
    The state holds the counts and that sum; a step changes the terms of the
    character that enters and of the one that leaves.
    """
    text = F.lower(match) if alphabet == alphabet.lower() else match
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
                        lambda c: F.position(c, F.lit(alphabet)))  # 1-based
    most = window * (math.log2(window) - bits) + 1e-9
    spans = F.array().cast("array<struct<start:int,end:int>>")
    # The span that may still grow is held beside the list; an end of -1 says that there is none.
    state = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
                     spans.alias("spans"), F.lit(0).alias("start"), F.lit(-1).alias("end"))

    def closed(acc):
        last = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["end"] >= 0, F.concat(acc["spans"], last)).otherwise(acc["spans"])

    def step(acc, i):
        codes, counts = acc["codes"], acc["counts"]
        full = i > window
        enters = F.element_at(codes, i)
        leaves = F.when(full, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
        had = F.element_at(counts, enters)
        left = F.when(full, F.element_at(counts, F.greatest(leaves, F.lit(1)))
                      + F.when(leaves == enters, 1).otherwise(0)).otherwise(F.lit(0))
        total = acc["sum"] + _xlogx(had + 1) - _xlogx(had) + _xlogx(left - 1) - _xlogx(left)
        now = F.transform(counts, lambda c, k: c + F.when(k + 1 == enters, 1).otherwise(0)
                          - F.when(k + 1 == leaves, 1).otherwise(0))
        start, end = (i - window).cast("int"), i.cast("int")
        hit = (i >= window) & (total <= most)
        fresh = hit & (start > acc["end"])
        return F.struct(codes.alias("codes"), now.alias("counts"), total.alias("sum"),
                        F.when(fresh, closed(acc)).otherwise(acc["spans"]).alias("spans"),
                        F.when(fresh, start).otherwise(acc["start"]).alias("start"),
                        F.when(hit, end).otherwise(acc["end"]).alias("end"))

    return F.aggregate(F.sequence(F.lit(1), F.length(match)), state, step, closed)


def _without_words(text: Column) -> Column:
    """The text with blanks in place of the allowed words; positions stay."""
    out = text
    for size in sorted({len(w) for w in WORDS}):
        out = F.regexp_replace(out, "(?i)" + "|".join(w for w in WORDS if len(w) == size), " " * size)
    return F.when(text.rlike("(?i)" + "|".join(WORDS)), out).otherwise(text)


def _entropy_spans(text: Column, name: str) -> Column:
    pattern, alphabet, window, bits = CLASSES[name]

    def suspicious(m):
        allowed = F.lit(False)
        for rule in ALLOWED:
            allowed = allowed | m["match"].rlike(rule)
        return ~allowed

    def shifted(m):
        return F.transform(_entropy_windows(m["match"], alphabet, window, bits),
                           lambda w: _span(m["start"] + w["start"], "entropy", m["start"] + w["end"]))

    return F.flatten(F.transform(F.filter(_matches(_without_words(text), pattern), suspicious), shifted))


def secret_spans(text: Column) -> Column:
    """Distinct (start, kind, end) of all kinds, by start, then kind; kind numbers index ``KIND_ORDER``."""
    text = F.coalesce(text, F.lit(""))
    found = [_pattern_spans(text, k) for k in KINDS] + [_entropy_spans(text, c) for c in CLASSES]
    # Two classes may find one span; sorted, equal ones are neighbours.
    return _let(F.array_sort(F.concat(*found)),
                lambda spans: F.filter(spans, lambda x, i: (i == 0) | (x != F.element_at(spans, F.greatest(i, F.lit(1))))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KIND_ORDER])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: spans as a list, their joined text, counts and digest of the pattern kinds."""
    found = docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col)).alias("found"))
    base = F.filter("found", lambda x: x["kind"] < len(KINDS))
    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == KIND_ORDER.index(kind))).cast("long")

    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The rows with every span, overlapping ones together, replaced by ``mask``."""
    held = free_name("found", docs.columns)
    text, spans = F.col(f"`{text_col}`"), F.col(held)

    def through(acc, block):
        at = F.greatest(acc["at"], F.array_max(F.transform(block, lambda x: x["end"])))
        row = F.struct(block.alias("spans"), acc["at"].alias("at"), at.alias("end"))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def masked(block):
        # A block's own stretch of text, so that no piece is looked for from the text's start.
        first = block["at"]
        state = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out"))

        def pieces(own):
            def cut(acc, x):
                piece = F.concat(F.substr(own, acc["at"] - first + 1, x["start"] - acc["at"]), F.lit(mask))
                return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(
                    x["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

            return F.array_join(F.aggregate(block["spans"], state, cut, lambda acc: acc["out"]), "")

        return _let(F.substr(text, first + 1, block["end"] - first), pieces)

    none = F.array().cast("array<struct<spans:array<struct<start:int,kind:int,end:int>>,at:int,end:int>>")
    blocks = F.aggregate(_blocks(spans), F.struct(F.lit(0).alias("at"), none.alias("out")), through, lambda acc: acc["out"])
    out = F.concat(F.array_join(F.transform(blocks, masked), ""), F.substr(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1))
    return (docs.withColumn(held, secret_spans(text))
            .withColumn(text_col, F.when(F.size(spans) > 0, out).otherwise(text)).drop(held))
