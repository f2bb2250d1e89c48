"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. For each kind the text is split by the kind's pattern; the pieces between the matches and the
matches give every match's place by a running sum of their lengths. The patterns are written so that no text makes them
slow: a run of characters is entered only at its start or where the last match ended, and loops don't backtrack.

An account number's match is only its first four characters; what may follow is looked ahead at. Of the places where a
word ends there, the number ends at the one of its country's length if the checksum holds, else at the last where it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: The kinds in order, with pattern (what it starts with is looked at first, as looking behind takes longer),
#: characters that each match must hold, score and context words.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write"),
    "ip": (r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 0.6, r"\bip\b|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, r"card|visa|master|credit|pay"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"phone|tel|call|mobile|fax"),
    "iban": (r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))", "", 0.8, r"iban|account|bank|konto"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"\bssn\b|social|security"),
    "key": (r"(?=A)(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", "IA", 0.8, r"key|access|secret"),
    "token": (r"(?=[0-9a-f])(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])", "", 0.3, r"token|secret|passw|key"),
}
BASE = ("email", "ip", "card", "phone")
#: The countries' lengths of account numbers.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
CONTEXT_CHARS, BOOST, LEAST = 40, 0.3, 0.5
SPAN, BLOCK = "struct<start:int,kind_no:int,end:int,kind:string,score:double>", 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an account number's letters and digits, first four last, are 1 modulo 97."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c <= "9", acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int")) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(part(p).cast("int") <= 255))
    if kind == "card":
        return F.when((n < 12) | (n > 19), False).otherwise(F.call_function("luhn_check", _digits(m)))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _account_end(m: Column) -> Column:
    """Where in ``m`` the account number ends that starts there; null if none does."""
    size = lambda k: F.length(F.regexp_replace(F.substring(m, F.lit(1), k), " ", ""))
    ends = F.filter(F.sequence(F.lit(15), F.length(m)), lambda k: F.substring(m, k + 1, F.lit(1)).isin("", " ") & (size(k) >= 15) & (size(k) <= 34))
    fine = F.filter(ends, lambda k: _mod97(F.substring(m, F.lit(1), k)))
    sizes = F.create_map(*[F.lit(x) for n, names in IBAN_SIZES.items() for c in names.split() for x in (c, n)])
    return F.coalesce(F.array_max(F.filter(fine, lambda k: size(k) == sizes[F.substring(m, 1, 2)])), F.array_max(fine))


def _running(values: Column) -> Column:
    """Running sums of an array of integers: in pass k each adds the one 2^k places before, so n take log n passes."""
    passes = F.ceil(F.log2(F.size(values).cast("double"))).cast("int")
    step = lambda k: F.call_function("shiftleft", F.lit(1), k)
    shifted = lambda acc, k: F.concat(F.array_repeat(F.lit(0), step(k)), F.slice(acc, F.lit(1), F.size(acc) - step(k)))
    added = F.aggregate(F.sequence(F.lit(0), passes - 1), values, lambda acc, k: F.zip_with(acc, shifted(acc, k), lambda x, y: x + y))
    return F.when(F.size(values) > 1, added).otherwise(values)


def _apart(spans: Column) -> Column:
    """Of spans in the order of their starts, each that starts at or after the end of the last one taken. They are taken
    by blocks, as an array that grows is copied whenever it does."""
    span = f"array<{SPAN}>"

    def one(acc: Column, x: Column) -> Column:
        good = x["start"] >= acc["end"]
        return F.struct(F.when(good, x["end"]).otherwise(acc["end"]).alias("end"), F.when(good, F.concat(acc["took"], F.array(x))).otherwise(acc["took"]).alias("took"))

    def block(acc: Column, k: Column) -> Column:
        some = F.aggregate(F.slice(spans, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["end"].alias("end"), F.array().cast(span).alias("took")), one)
        return F.struct(some["end"].alias("end"), F.concat(acc["took"], F.array(some["took"])).alias("took"))

    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{span}>").alias("took"))
    took = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), start, block, lambda acc: F.flatten(acc["took"]))
    return F.when(F.size(spans) > 1, took).otherwise(spans)


def _spans(text: Column, kind: str, order: int) -> Column:
    """array<SPAN> of the valid matches of one kind."""
    pattern, needs, score, words = KINDS[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    past = _running(F.zip_with(before, values, lambda s, m: F.length(s) + F.length(m)))
    pairs = F.arrays_zip(values.alias("m"), before.alias("s"), past.alias("past"))
    if kind == "iban":
        rest = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        ends = F.transform(F.arrays_zip(values.alias("m"), rest.alias("r")), lambda x: _account_end(F.concat(x["m"], x["r"])))
        pairs = F.arrays_zip(values.alias("m"), before.alias("s"), past.alias("past"), ends.alias("n"))

    def span(x: Column) -> Column:
        near = F.when(F.lower(F.right(x["s"], F.lit(CONTEXT_CHARS))).rlike(words), F.lit(BOOST)).otherwise(0.0)
        sure = F.least(F.lit(score) + near, F.lit(1.0))
        start = x["past"] - F.length(x["m"])
        end = start + x["n"] if kind == "iban" else x["past"]
        return F.struct(start.alias("start"), F.lit(order).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), sure.alias("score")).cast(SPAN)

    good = (lambda x: x["n"].isNotNull()) if kind == "iban" else (lambda x: _valid(kind, x["m"]))
    found = F.transform(F.filter(pairs, good), span)
    if kind not in BASE:
        found = F.filter(found, lambda x: x["score"] >= LEAST)
    if kind == "iban":
        found = _apart(found)
    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(F.contains(text, F.lit(needs)) if needs else F.lit(True), F.when(text.rlike(pattern), found).otherwise(empty)).otherwise(empty)


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id and ``found``, an array of spans ordered by start, then kind.

    A span has start, kind_no, end (code points, end exclusive), kind and score. Spans of the four base kinds are all
    that pass their check; account numbers (mod 97), social security numbers, access keys and hexadecimal tokens are added
    where their score, raised by context words in the 40 characters before them, reaches 0.5. Null text is empty; null ids and repeated rows keep
    their rows; an empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text).alias("t"))
    each = [_spans(F.col("t"), k, i) for i, k in enumerate(KINDS)]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def _mask(kind: str):
    return lambda m: F.when(_valid(kind, m), F.lit(f"<{kind}>")).otherwise(m)


def masked(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every base match in ``text`` that passes its check replaced by its kind in angle brackets."""
    t = text_of(docs, text)
    for kind in BASE:
        pattern, needs, _, _ = KINDS[kind]
        values = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        between = F.split(t, pattern, -1)
        kept = F.transform(values, _mask(kind))
        t = F.when(t.rlike(pattern), F.array_join(F.flatten(F.zip_with(between, kept, lambda s, m: F.array(s, F.coalesce(m, F.lit(""))))), "")).otherwise(t)
    return docs.withColumn(text, t)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
