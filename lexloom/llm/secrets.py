"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions only near hits, then embedded checksums.

One map over the table, in Arrow batches and without a shuffle. The automaton runs once over the ASCII-lower-cased
bytes of a text; patterns are only matched (never searched) at places that its hits give. No character is read again by
a pattern that has failed on the run it belongs to, so the work is linear in the text.

Hexadecimal runs have no keyword. Each of the 65,536 grams of four digits is one, made by a rule: prose has few of them,
and within a run only the first is followed up; a text of digits costs one hit a character.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.columns import id_text
from lexloom.llm.words import portions

#: Kinds in output order; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_PART = re.compile(rb"[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: A run of hex digits shows itself by its first HEX_GRAM digits, each such gram being a keyword of the automaton.
HEX_GRAM = 4

SCHEMA = "id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@cache
def automaton() -> ahocorasick.Automaton:
    """Keywords of all kinds, over lower-cased text; a value is (kind, keyword length). Built once per worker."""
    found = ahocorasick.Automaton()
    for gram in product("0123456789abcdef", repeat=HEX_GRAM):
        found.add_word("".join(gram), ("hex", HEX_GRAM))
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    for word, kind in (("akia", "access"), ("npm_", "npm"), ("eyj", "jwt"), ("-----begin ", "pem"), *((f"gh{c}_", "github") for c in "pousr")):
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _checksum(body: bytes, tail: bytes) -> bool:
    """Whether the base-62 tail is the CRC-32 of the body, as in tokens of package and code hosts."""
    value, digits = binascii.crc32(body), b""
    for _ in range(6):
        value, r = divmod(value, 62)
        digits = BASE62[r : r + 1] + digits
    return digits == tail


def _header(part: bytes) -> bool:
    """Whether a token's first part decodes to a JSON object that names its algorithm."""
    try:
        found = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # not JSON, or nested too deeply to be a header
        return False
    return isinstance(found, dict) and "alg" in found


def _keep(kind: str, m: re.Match[bytes]) -> bool:
    if kind == "assign":
        return len(m[2]) >= LEAST[kind]
    if kind in LEAST:
        return len(m[0]) >= LEAST[kind]
    if kind in ("github", "npm"):
        return _checksum(m[1], m[2])
    return kind != "jwt" or _header(m[1])


_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "github": GITHUB, "npm": NPM, "jwt": JWT, "pem": PEM}


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in bytes as spans in code points; each stretch between two ends is decoded once."""
    at, places, done = 0, {}, 0
    for end in sorted({x for a, _, b in spans for x in (a, b)}):
        at += len(data[done:end].decode())
        places[end] = at
        done = end
    return [(places[a], k, places[b]) for a, k, b in spans]


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by kind as listed; null counts as empty."""
    if not text:
        return []
    data = text.encode()
    done = dict.fromkeys(KINDS, 0)
    spans = []
    # no keyword lies within another of its kind, so the hits of a kind come in order of their starts
    for at, (kind, n) in automaton().iter(data.lower().decode("latin-1")):
        start = at - n + 1
        if start < done[kind]:
            continue
        if m := _ANCHORED[kind].match(data, start):
            done[kind] = m.end()
            if _keep(kind, m):
                spans.append((start, KINDS.index(kind), m.end()))
        elif kind == "jwt":
            done[kind] = _PART.match(data, start).end()  # from anywhere in this part the rest fails likewise
    if spans and len(data) != len(text):
        spans = _code_points(data, spans)
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, _ARROW)], names=["id", "spans"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each input row; spans by start, then kind.

    Within a kind, matches are the leftmost ones without overlap; a match that fails its length or checksum test is
    dropped and its characters are not tried again. Null and empty texts have no spans; repeated rows each give a row;
    a null id stays null; other columns are ignored. A text is scanned whole, whatever its length.
    """
    base = id_text(df, id_col, text_col)
    return base.select(base["id"].cast("bigint").alias("id"), "text").mapInArrow(_batches, SCHEMA)
