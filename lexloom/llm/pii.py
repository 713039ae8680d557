"""PII spans: regular expressions propose, checksum validators confirm, nearby context words adjust the score.

Native: regexp_extract_all gives the matches and split the gaps between them; running sums of their lengths, counted in
code points and in bytes, are the spans' places. There is no shuffle, and the work is linear in a text's matches. The
patterns are written so that Java's matcher neither recurses nor backtracks over long runs: single character classes
with lazy or possessive repeats, and a look-behind (or the end of the previous match) where a run may only be entered at
its start.

Words near a span raise or lower the kind's prior score. Kinds that many harmless numbers look like (national phone
numbers, social security numbers) are spans only where context lifts them to LEAST_SCORE; of the others, whose form says
enough to be listed, redaction spares those that context lowers below it, such as version numbers that look like
addresses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.columns import id_text, let, running

#: Characters of an IBAN by country: printed in groups, only its length tells where it ends.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK|FO|FI|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "HR|CH|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_PRINTED = "|".join(rf"(?:{of})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, of in IBAN_CHARS.items())
#: Of other countries the longest run of groups is tried.
_PRINTED += rf"|(?!{'|'.join(IBAN_CHARS.values())})[A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?"
#: Kinds in output order (the first four are the base kinds), their patterns and prior scores, the words
#: that raise these and those that lower them.
KINDS = ("email", "ip", "card", "phone", "iban", "local", "ssn")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=(?:[ -]?[0-9]){13})[0-9 -]*?(?=[ -]{2}|[ -]?(?![0-9 -]))",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_PRINTED})(?![A-Za-z0-9])",
    "local": r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
PRIOR = {"email": 0.75, "ip": 0.5, "card": 0.75, "phone": 0.5, "iban": 0.75, "local": 0.25, "ssn": 0.25}
RAISING = {
    "email": "e-?mail|mail|mailto|contact|write|reply",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|call|tel|telephone|mobile|cell|fax",
    "iban": "iban|bank|account|transfer",
    "local": "phone|call|tel|telephone|mobile|cell|fax",
    "ssn": "ssn|social security|taxpayer",
}
LOWERING = {"ip": "version|release|firmware|build|section", "local": "order|invoice|part|serial", "ssn": "order|invoice|part|serial"}
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.25
#: Where weak kinds count, and where redaction cuts.
LEAST_SCORE = 0.5
#: Kinds that are spans only from LEAST_SCORE on.
WEAK = ("local", "ssn")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits has a valid Luhn check digit."""
    padded = F.lpad(digits, 19, "0")
    terms = []
    for k in range(19):
        d = F.substring(padded, 19 - k, 1).cast("int")
        terms.append(d if k % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return reduce(lambda a, b: a + b, terms) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes the mod-97 check: the first four characters move to the end, letters count from 10."""
    chars = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = F.translate(x, " -", "")
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(x, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(x, F.lit(" "), F.lit("")))
    return F.lit(True)


#: A cheap test that holds for every text with a match of the kind.
_HINT = {"email": "@", "phone": r"\+", "ip": r"[0-9]\.[0-9]+\.[0-9]", "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "local": "[0-9]{3}[ .-][0-9]{4}", "ssn": "[0-9]{3}-[0-9]{2}-"}
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,low:bigint,high:bigint>>"


def _near(words: str, before: Column, after: Column) -> Column:
    """Whether one of the words, whole, stands in the last or first characters of what is around a match."""
    rule = rf"(?i)(?<![a-z])(?:{words})(?![a-z])"
    return F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS).rlike(rule) | F.substring(after, 1, CONTEXT_CHARS).rlike(rule)


def _score(kind: str, before: Column, after: Column) -> Column:
    raised = F.when(_near(RAISING[kind], before, after), CONTEXT_GAIN).otherwise(0.0)
    lowered = F.when(_near(LOWERING[kind], before, after), CONTEXT_GAIN).otherwise(0.0) if kind in LOWERING else F.lit(0.0)
    return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + raised - lowered)


def _spans_of(kind: str) -> Column:
    """The spans of one kind; null where the text has no match."""
    text = F.col("text")
    add = lambda a, b: a + b
    sizes = lambda of, g, m: F.zip_with(g, m, lambda x, y: of(x).cast("bigint") + of(y).cast("bigint"))

    def row(z: Column) -> Column:
        start, low = z["s"] + F.length(z["g"]), z["b"] + F.octet_length(z["g"])
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(z["m"])).alias("end"), _score(kind, z["g"], z["n"]).alias("score"),
            low.alias("low"), (low + F.octet_length(z["m"])).alias("high"), _valid(kind, z["m"]).alias("ok"),
        )

    def placed(m: Column) -> Column:
        def cut(g: Column) -> Column:
            own = F.slice(g, F.lit(1), F.size(m))
            zipped = F.arrays_zip(
                m.alias("m"), own.alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("n"),
                F.slice(running(sizes(F.length, own, m), add), F.lit(1), F.size(m)).alias("s"), F.slice(running(sizes(F.octet_length, own, m), add), F.lit(1), F.size(m)).alias("b"),
            )
            return F.transform(F.filter(F.transform(zipped, row), lambda x: x["ok"] & (x["score"] >= LEAST_SCORE) if kind in WEAK else x["ok"]), lambda x: x.dropFields("ok"))

        return F.when(F.size(m) > 0, let(F.split(text, PATTERNS[kind], -1), cut))

    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return let(F.when(text.rlike(_HINT[kind]), found) if kind in _HINT else found, placed)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) for each input row, in no order; spans: array of (start, rank, kind, end, score, low, high) by
    start, then kind.

    start and end are code points, low and high bytes of UTF-8; ends are exclusive. Base kinds are leftmost matches
    without overlap within a kind; a match that fails its validator is dropped and not retried. Score: the kind's prior,
    plus CONTEXT_GAIN if a raising word, less CONTEXT_GAIN if a lowering word stands, whole, in the CONTEXT_CHARS code
    points before or after the span and between the kind's matches on either side, at most 1; the weak kinds need
    LEAST_SCORE. Null and empty texts have no spans; repeated rows each give a row; a null id stays null; other columns
    are ignored; an empty table gives no rows.
    """
    none = F.array().cast(_SPAN)
    return id_text(df, id_col, text_col).select("id", "text", F.array_sort(F.concat(*[F.coalesce(_spans_of(k), none) for k in KINDS])).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, text, n_redacted): each span with at least ``least_score`` becomes ``[KIND]``.

    Overlapping spans of different kinds are replaced as one, under the kind of the first. Texts without spans, and
    null texts as empty ones, stay as they are. The text is cut by bytes, so the work is linear in its spans.
    """
    found = find_pii(df, id_col, text_col)
    kept = found.select("id", "text", F.filter("spans", lambda s: s["score"] >= least_score).alias("spans"))

    def runs(spans: Column) -> Column:
        """(low, kind, high) of each run of overlapping spans: one begins where all before have ended, and ends with the last of them."""
        reached = running(F.transform(spans, lambda s: s["high"]), lambda a, b: F.greatest(a, b))
        rows = lambda r: F.arrays_zip(spans.alias("s"), F.slice(r, F.lit(1), F.size(spans)).alias("r"))
        first = lambda r: F.filter(rows(r), lambda z: z["s"]["low"] >= z["r"])
        ends = lambda r, f: F.concat(F.transform(F.slice(f, F.lit(2), F.size(f)), lambda z: z["r"]), F.array(F.element_at(r, -1)))
        return let(reached, lambda r: let(first(r), lambda f: F.zip_with(f, ends(r, f), lambda z, high: F.struct(z["s"]["low"].alias("low"), F.upper(z["s"]["kind"]).alias("kind"), high.alias("high")))))

    def clean(cuts: Column, data: Column) -> Column:
        part = lambda low, high: F.decode(F.substring(data, (low + 1).cast("int"), (high - low).cast("int")), "UTF-8")
        begun = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda c: c["high"]))
        pieces = F.zip_with(cuts, begun, lambda c, low: F.concat(part(low, c["low"]), F.lit("["), c["kind"], F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(cuts, -1)["high"], F.octet_length(data).cast("bigint")))

    def both(cuts: Column) -> Column:
        return F.struct(let(F.col("text").cast("binary"), lambda data: clean(cuts, data)).alias("text"), F.size(cuts).cast("bigint").alias("n"))

    done = kept.select("id", "text", F.when(F.size("spans") > 0, let(F.col("spans"), lambda s: let(runs(s), both))).alias("done"))
    return done.select("id", F.coalesce("done.text", "text").alias("text"), F.coalesce("done.n", F.lit(0).cast("bigint")).alias("n_redacted"))
