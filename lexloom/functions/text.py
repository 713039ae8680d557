"""Text functions. The parse and normalisation variants differ on purpose: ids depend on each of them, never merge them.

All are Catalyst expressions, but for the Unicode part of ``normalize_strict``, an Arrow UDF that only non-ASCII
strings reach. Null strings count as empty unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separator inside hashed ids, white space as str.strip() sees it, and the table of typographic
#: quotes and primes with their plain forms that the documented normaliser replaces.
ID_SEPARATOR = "␟"
SPACE = "[\\s\\x1c-\\x1f]"
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"'}


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends, as Python's str.strip(); Spark's trim only removes spaces."""
    return F.regexp_replace(F.regexp_replace(text(c), f"(?U)^{SPACE}+", ""), f"(?U){SPACE}+$", "")


def _ascii_normal(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))
    return F.trim(F.lower(F.regexp_replace(plain, f"{SPACE}+", " ")))


@F.pandas_udf(T.StringType())
def _unicode_normal(s: pd.Series) -> pd.Series:
    def one(x: str) -> str:
        x = unicodedata.normalize("NFKC", x).replace('\\"', '"').replace("\\'", "'").replace("\u200b", "")
        return " ".join(x.split()).casefold().strip()

    return s.map(one)


@F.pandas_udf(T.StringType())
def _intended_normal(s: pd.Series) -> pd.Series:
    table = str.maketrans(QUOTES | {"_": " ", "\u200b": ""})

    def one(x: str) -> str:
        x = unicodedata.normalize("NFKC", x.translate(table)).replace('\\"', '"').replace("\\'", "'")
        return " ".join(x.split()).casefold()

    return s.map(one)


def normalize_strict(c: Column | str, compat: bool = True) -> Column:
    """Descriptor normaliser of the extractor (N1): NFKC, unescaped quotes, white space runs to one space, no zero-width
    spaces, case folded, stripped.

    ``compat`` keeps what stable ids were built with: typographic quotes and underscores stay. With ``compat=False``
    quotes become plain and underscores spaces, as its documentation intends. ASCII strings stay in the JVM.
    """
    c = text(c)
    if not compat:
        return _intended_normal(c)
    is_ascii = F.octet_length(c) == F.length(c)
    return F.when(is_ascii, _ascii_normal(c)).otherwise(_unicode_normal(F.when(~is_ascii, c).otherwise(F.lit(""))))


def normalize_counter(c: Column | str) -> Column:
    """Normaliser of the frequency counter (N2): strip, lower, runs of underscores and white space to one space.

    A leading or trailing underscore leaves a space behind.
    """
    return F.regexp_replace(F.lower(strip(c)), "(?U)[_\\s\\x1c-\\x1f]+", " ")


def normalize_tracer(c: Column | str) -> Column:
    """Normaliser of the backward tracer (N3): the same runs to one space first, then strip and lower."""
    return F.lower(strip(F.regexp_replace(text(c), "(?U)[_\\s\\x1c-\\x1f]+", " ")))


def _halves(c: Column) -> tuple[Column, Column, Column]:
    parts = F.split(c, ";", 2)
    return F.get(parts, 0), F.get(parts, 1), F.size(parts) == 2


def split_strict(c: Column | str, compat: bool = True) -> Column:
    """N1 pair: struct(descriptor, explainer, ok). ok tests both halves for emptiness before anything is stripped, so
    a pair of blanks is well-formed with empty texts; a missing ``;`` gives empty halves that are not ok."""
    d, e, both = _halves(text(c))
    ok = both & (d != "") & (F.coalesce(e, F.lit("")) != "")
    return F.struct(F.when(both, normalize_strict(d, compat)).otherwise("").alias("descriptor"), F.when(both, strip(e)).otherwise("").alias("explainer"), F.coalesce(ok, F.lit(False)).alias("ok"))


def split_counter(c: Column | str) -> Column:
    """N2 pair: both halves are normalised or stripped first, and dropped (null struct) if one is then empty."""
    d, e, both = _halves(text(c))
    d, e = F.trim(normalize_counter(d)), strip(e)
    return F.when(both & (d != "") & (e != ""), F.struct(d.alias("descriptor"), e.alias("explainer")))


def split_tracer(c: Column | str) -> Column:
    """N3 pair: as N2 with the tracer's normaliser."""
    d, e, both = _halves(text(c))
    d, e = normalize_tracer(d), strip(e)
    return F.when(both & (d != "") & (e != ""), F.struct(d.alias("descriptor"), e.alias("explainer")))


def split_plain(c: Column | str) -> Column:
    """N4 pair: strip, split once, strip both; without ``;`` all is the descriptor. Nothing is normalised."""
    whole = strip(c)
    d, e, both = _halves(whole)
    return F.struct(F.when(both, strip(d)).otherwise(whole).alias("descriptor"), F.when(both, strip(e)).otherwise("").alias("explainer"))


def vocab_descriptor(c: Column | str) -> Column:
    """N5: what precedes the first ``;``, stripped; the whole stripped string where there is none."""
    return strip(F.get(F.split(text(c), ";", 2), 0))


def training_descriptor(c: Column | str) -> Column:
    """N6: as N5, but null where there is no ``;``."""
    d, _, both = _halves(text(c))
    return F.when(both, strip(d))


def remove_explanations(arr: Column | str) -> Column:
    """N5 over an array of pair strings."""
    return F.transform(arr, vocab_descriptor)


def stable_id(descriptor: Column | str, explainer: Column | str) -> Column:
    """The first 12 hex digits of the SHA-1 of descriptor, separator and explainer."""
    return F.substring(F.sha1(F.concat(text(descriptor), F.lit(ID_SEPARATOR), text(explainer))), 1, 12)


def merged_id(sources: Column, descriptor: Column, explainer: Column) -> Column:
    """A repeatable id for a merged pair: 32 hex digits from its sorted sources and text, so never one of 12."""
    return F.substring(F.sha2(F.concat_ws(ID_SEPARATOR, F.array_join(F.array_sort(sources), ","), text(descriptor), text(explainer)), 256), 1, 32)


def pair_text(descriptor: Column | str, explainer: Column | str) -> Column:
    """``descriptor; explainer``, or the one that is not empty."""
    return F.concat_ws("; ", F.nullif(strip(descriptor), F.lit("")), F.nullif(strip(explainer), F.lit("")))


def sanitize(data: Column) -> Column:
    """Bytes as text: encoded surrogates go, other bytes that are no UTF-8 become the replacement character."""
    # as one character a byte, so that a pattern can name bytes
    bare = F.regexp_replace(F.decode(data, "ISO-8859-1"), "\u00ed[\u00a0-\u00bf][\u0080-\u00bf]", "")
    return F.make_valid_utf8(F.encode(bare, "ISO-8859-1").cast("string"))


def remove_thinking(c: Column | str) -> Column:
    """What follows the first ``assistantfinal``, in any case, without leading white space; all if there is none."""
    return F.regexp_replace(text(c), "(?is)^.*?assistantfinal\\s*", "")


def remove_think_tags(c: Column | str) -> Column:
    """Without <think> sections, then without any of the characters of a fenced json block at both ends."""
    return F.btrim(F.regexp_replace(text(c), "(?s)<think>.*?</think>", ""), F.lit("` \njson"))


def lexical_overlap(a: Column | str, b: Column | str) -> Column:
    """The number of different lower-cased words that both texts hold."""
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(strip(c)), f"(?U){SPACE}+")), "")
    return F.size(F.array_intersect(words(a), words(b))).cast("bigint")


def truncate_quick(c: Column | str, max_tokens: int, chars_per_token: int = 3) -> Column:
    """The first characters that fit the token budget, marked if something was cut."""
    n = max_tokens * chars_per_token
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("\n[TRUNCATED]"))).otherwise(F.col(c) if isinstance(c, str) else c)


def preview(c: Column | str, n: int = 200) -> Column:
    """Line feeds as spaces, stripped, cut after n characters with dots."""
    flat = strip(F.replace(text(c), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def split_queries(c: Column | str) -> Column:
    """Comma-separated queries, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(c), ","), strip), lambda x: x != "")


def clean_chosen_id(c: Column | str) -> Column:
    """A model's chosen id without white space, quotes, backticks and an ``id=`` before it; null if nothing is left."""
    bare = F.btrim(strip(c), F.lit("\"'` "))
    return F.nullif(strip(F.btrim(F.regexp_replace(bare, "(?i)^id=\\s*", ""), F.lit("\"'`"))), F.lit(""))


def keep_index(c: Column | str, n: Column) -> Column:
    """The index after the last colon of a model's answer, as a number below n; null if it is none."""
    found = F.regexp_extract(strip(c), "(?:^|:)\\s*(\\d{1,9})$", 1)
    number = F.when(found != "", found.cast("int"))
    return F.when(number < n, number)


def answer_label(c: Column | str, labels: list[str]) -> Column:
    """The label that a judge's answer begins with: what follows the first ``answer:``, lower-cased, without marks
    around it; longer labels are tried first; ``invalid`` if none fits as a whole word."""
    low = F.lower(text(c))
    after = F.when(F.instr(low, "answer:") > 0, F.regexp_replace(low, "(?s)^.*?answer:", "")).otherwise(low)
    bare = F.btrim(after, F.lit(" *:!?.-\n\r\t\""))
    either = "|".join(sorted((x.lower() for x in labels), key=lambda x: (-len(x), x)))
    found = F.regexp_extract(bare, f"^({either})\\b", 1)
    return F.when(found == "", "invalid").otherwise(found)


def verdict_yes(c: Column | str) -> Column:
    """Whether an answer, without stars and spaces at its ends, ends in ``answer: yes``."""
    return F.btrim(F.lower(text(c)), F.lit("* \n")).endswith("answer: yes")


def parse_model_json(c: Column | str, schema: str) -> Column:
    """A model's JSON answer as a struct: backticks and a ``json`` mark are dropped, what surrounds the outermost braces
    ignored, trailing commas and single quotes repaired; null where that does not help."""
    bare = F.regexp_replace(F.btrim(strip(c), F.lit("` \n")), "^json", "")
    inner = F.regexp_extract(bare, "(?s)(\\{.*\\})", 1)
    tries = [inner, F.regexp_replace(inner, ",\\s*([}\\]])", "$1"), F.replace(F.regexp_replace(inner, ",\\s*([}\\]])", "$1"), F.lit("'"), F.lit('"'))]
    good = lambda x: F.try_parse_json(x).isNotNull()
    whole = F.coalesce(*[F.when((x != "") & good(x), x) for x in tries])
    return F.from_json(whole, schema)


#: The steps of the repair of a judge's JSON, as patterns and replacements, in their order.
REPAIR_STEPS = (
    (",\\s*([\\]}])", "$1"),
    ("([{,])\\s*([a-zA-Z_][a-zA-Z0-9_]*)\\s*:", "$1\"$2\":"),
    (":\\s*([^\"\\s\\d\\[{].*?)(?=[,}\\]])", ":\"$1\""),
)


def repaired_json(c: Column | str) -> Column:
    """A judge's answer as JSON text after one round of repair, null if it is none then: what stands from the first brace to
    the first closing one, double quotes for single ones, no trailing commas, quotes around bare keys and bare values."""
    bare = F.btrim(text(c), F.lit(" \n"))
    low, high = F.instr(bare, "{"), F.instr(bare, "}")
    fixed = F.replace(F.when((low > 0) & (high >= low), bare.substr(low, high - low + 1)).otherwise(bare), F.lit("'"), F.lit('"'))
    for pattern, by in REPAIR_STEPS:
        fixed = F.regexp_replace(fixed, pattern, by)
    return F.when(F.try_parse_json(fixed).isNotNull(), fixed)


def completed(answer: Column, lists: tuple[str, ...] = ("descriptors", "specifics"), texts: tuple[str, ...] = ("general",)) -> Column:
    """A generator's answer, JSON text or null, as a struct of all its fields: missing lists are empty, missing texts "",
    and the items of lists are strings whatever they were."""
    items = lambda name: F.coalesce(F.transform(F.from_json(F.get_json_object(answer, f"$.{name}"), "array<string>"), text), F.array().cast("array<string>"))
    return F.struct(*[items(n).alias(n) for n in lists], *[F.coalesce(F.get_json_object(answer, f"$.{n}"), F.lit("")).alias(n) for n in texts])


def truncate_tokens(c: Column | str, most: int) -> Column:
    """The first ``most`` tokens of a text, as the stand-in tokenizer has them: runs without white space, with what follows."""
    found = F.regexp_extract_all(text(c), F.lit("\\s*\\S+"), F.lit(0))
    return F.when(F.size(found) > most, F.array_join(F.slice(found, 1, most), "")).otherwise(text(c))


def decision_key(a: Column, b: Column) -> Column:
    """A cache key of two pairs (structs with an id), the same in either order."""
    return F.sha2(F.to_json(F.struct(F.array_sort(F.array(a, b)).alias("pair"))), 256)


def choice_key(query: Column, candidates: Column) -> Column:
    """A cache key of a query text and its candidates in their order."""
    return F.sha2(F.concat_ws("|", query, F.array_join(candidates, "|")), 256)


def fingerprint(model: str, rows: Column) -> Column:
    """An aggregate that names an embedding table: model, ids and texts of all rows, in id order; ``rows`` is a struct.

    The digest is a sum of row hashes with the count, so that no task gathers the table.
    """
    digest = F.xxhash64(rows)
    return F.sha2(F.concat_ws("|", F.lit(model), F.count("*").cast("string"), F.sum(digest.cast("decimal(38,0)")).cast("string"), F.bit_xor(digest).cast("string")), 256)
