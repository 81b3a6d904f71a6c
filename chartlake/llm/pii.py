"""Personal data in texts (DataFrame functions only).

Regular expressions propose spans, validators confirm them (Luhn for cards, number ranges for addresses,
digit counts for phones, mod-97 for account numbers), and words near a span adjust its score. The four base
kinds start at the acceptance score, so nothing takes them away; the added kinds (``iban``, ``local_phone``,
``ssn``) start lower and are accepted on a checksum or on context words.

Positions: each pattern's matches are fenced by a control character, the text is split at the fences, and the
lengths of the pieces give starts and ends in code points. The patterns are possessive, so a match takes
time linear in its length and no stack, however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import text_or_empty

_FENCE = "\x01"
_MAIL = "A-Za-z0-9._%+-"
#: kind -> pattern. ``\G`` and the look-behinds only skip starts that cannot be leftmost.
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED_PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = tuple(BASE_PATTERNS)
#: Context words raise the score of an added kind by 0.4, deniers lower it by 0.4.
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
DENY = ("isbn", "order", "serial", "version", "invoice", "part no", "sku")
START = {"email": 0.6, "ip": 0.6, "card": 0.6, "phone": 0.6, "iban": 0.6, "local_phone": 0.3, "ssn": 0.3}
ACCEPT = 0.5
#: Code points before a span that are searched for context words.
NEAR = 40


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits: doubled every second digit from the right, sum divisible by 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(
        i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 mod 97-10 check: first four characters to the end, letters as 10 to 35, remainder 1."""
    s = F.regexp_replace(account, "\\x20", "")
    s = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    values = F.transform(F.split(s, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(
        c.rlike("^[A-Z]$"), F.ascii(c) - 55))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda a, v: F.when(
        v > 9, a * 100 + v).otherwise(a * 10 + v) % 97) == 1


def _part_ok(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(999) <= 255)


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a kind's pattern passes the kind's check."""
    if kind == "ip":
        return F.forall(F.split(m, "\\."), _part_ok)
    if kind == "card":
        n = F.length(_digits(m))
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, "\\x20", "")).between(15, 34) & mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, start, end, match>> of a pattern's valid matches, leftmost and not overlapping."""
    fenced = F.regexp_replace(text, pattern, f"{_FENCE}$0{_FENCE}")
    pieces = F.split(fenced, _FENCE, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    acc = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("out"))

    def step(a, piece):
        end = a["at"] + F.length(piece)
        hit = F.array(F.struct(a["at"].alias("start"), end.alias("end"), piece.alias("match")))
        return F.struct(end.alias("at"), (a["i"] + 1).alias("i"),
                        F.when(a["i"] % 2 == 1, F.concat(a["out"], hit)).otherwise(a["out"]).alias("out"))

    found = F.when(F.size(pieces) > 1, F.aggregate(pieces, acc, step, lambda a: a["out"])).otherwise(none)
    return F.filter(found, lambda x: valid(kind, x["match"]))


#: A cheap test that a text can hold a match at all.
_HINT = {"email": "@", "phone": "+", "ssn": "-"}


def _score(text: Column, kind: str, x: Column) -> Column:
    near = F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - NEAR), F.least(x["start"], F.lit(NEAR))))
    has = lambda words: near.rlike("|".join(words))
    score = F.lit(START[kind])
    if kind in CONTEXT:
        score = score + F.when(has(CONTEXT[kind]), 0.4).otherwise(0.0) - F.when(has(DENY), 0.4).otherwise(0.0)
    return score


def _scored(text: Column, kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                              _score(text, kind, x).alias("score"))


def find_pii(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: array<struct<kind, start, end, score>> sorted by kind as listed, then start.

    Null and empty texts have no spans; other columns pass through; repeated rows are treated alike; an empty
    table gives an empty result. Added kinds never replace base spans; an added span that overlaps a base span
    is left out.
    """
    t = F.translate(text_or_empty(text), _FENCE, "\x02")
    df = docs.withColumn("_pii_text", t)
    names = {}
    for kind, pattern in {**BASE_PATTERNS, **ADDED_PATTERNS}.items():
        src = F.col("_pii_text")
        none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
        if kind == "local_phone" or kind == "iban":
            test = src.rlike(pattern)
        else:
            test = src.contains(_HINT[kind]) if kind in _HINT else src.rlike("[0-9]")
        spans = F.transform(_matches(src, kind, pattern), _scored(src, kind))
        df = df.withColumn(names.setdefault(kind, f"_pii_{kind}"), F.when(test, spans).otherwise(none))
    base = F.concat(*[F.col(names[k]) for k in BASE])
    df = df.withColumn("_pii_base", base)
    added = F.filter(F.concat(*[F.col(names[k]) for k in ADDED_PATTERNS]), lambda x: (x["score"] >= ACCEPT) & ~F.exists(
        F.col("_pii_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    df = df.withColumn(out, F.concat("_pii_base", added))
    return df.drop("_pii_text", "_pii_base", *names.values())


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span found in ``text`` by its kind in angle brackets; overlapping spans become one mark.

    Texts without spans, null texts among them, stay as they are; the columns stay the same.
    """
    df = find_pii(docs, text, "_pii_spans")
    ordered = F.array_sort(F.transform("_pii_spans", lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("neg"), x["kind"].alias("kind"))))
    merged = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda a, x: F.when(x["start"] >= a["at"], F.struct(
            (-x["neg"]).alias("at"),
            F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, x["start"] - a["at"]),
                     F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("done"),
        )).otherwise(F.struct(F.greatest(a["at"], -x["neg"]).alias("at"), a["done"].alias("done"))),
        lambda a: F.concat(a["done"], F.substring(F.col(text), a["at"] + 1, 2**31 - 1)),
    )
    new = F.when(F.size("_pii_spans") > 0, merged).otherwise(F.col(text))
    return df.withColumn(text, new).select(*docs.columns)
