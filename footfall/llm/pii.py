"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes, country codes); from each
anchor a small deterministic parser expands to the boundaries of its kind and validates what it found.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their listed order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "login")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+")
_LOGIN = re.compile(r"://[^\s/@:?#]+:[^\s/@?#]+@(?:[A-Za-z0-9-]+\.)*[A-Za-z0-9-]+")
_DIGITS = re.compile(r"[0-9]")

# Lengths of account numbers by country, from the public IBAN registry.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


_KEPT: dict[str, ahocorasick.Automaton] = {}


def _anchors() -> ahocorasick.Automaton:
    if "anchors" in _KEPT:
        return _KEPT["anchors"]
    found = ahocorasick.Automaton()
    found.add_word("@", "@")
    found.add_word("+", "+")
    found.add_word("://", ":")
    for digit in "0123456789":
        found.add_word(digit, "0")
    for code in IBAN_LENGTHS:
        found.add_word(code, code)
    found.make_automaton()
    _KEPT["anchors"] = found
    return found


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Local part left of the at-sign, not before ``least``; domain right of it."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _account(text: str, at: int, code: str) -> tuple[int, int] | None:
    """An IBAN from its country code, groups set apart by single spaces or not at all."""
    if at and text[at - 1].isalnum():
        return None
    run = _IBAN.match(text, at, at + 2 * IBAN_LENGTHS[code])
    if run is None:
        return None
    kept = 0
    for place in range(at, run.end()):
        kept += text[place] != " "
        if kept == IBAN_LENGTHS[code]:
            end = place + 1
            good = not text[end : end + 1].isalnum() and iban_valid(text[at:end].replace(" ", ""))
            return (at, end) if good else None
    return None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed. Base kinds: leftmost, not overlapping, failures dropped."""
    found = []
    done = dict.fromkeys(KINDS, 0)
    for last, anchor in _anchors().iter(text):
        if anchor == "0":
            if last >= done["ip"]:
                region = _DOTTED.match(text, last).end()
                done["ip"] = region
                if text.count(".", last, region) >= 3:
                    for m in _IP.finditer(text, last, region):
                        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                            found.append((m.start(), m.end(), "ip"))
            if last >= done["card"]:
                m = _CARD.match(text, last)
                done["card"] = m.end() if m else last + 1
                if m and m.end() - last >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, m.end(), "card"))
        elif anchor == "@":
            if span := _email(text, last, done["email"]):
                done["email"] = span[1]
                found.append((*span, "email"))
        elif anchor == "+":
            m = _PHONE.match(text, last)
            if m and 9 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((last, m.end(), "phone"))
        elif anchor == ":":
            at = last - 2
            start = at
            while start > done["login"] and (text[start - 1].isascii() and text[start - 1].isalnum()):
                start -= 1
            m = _LOGIN.match(text, at) if start < at else None
            if m:
                done["login"] = m.end()
                found.append((start, m.end(), "login"))
        elif last - 1 >= done["iban"] and (span := _account(text, last - 1, anchor)):
            done["iban"] = span[1]
            found.append((*span, "iban"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def pii_spans(text: Column) -> Column:
    """Spans of personal data in a text column (null: none), in code points, end exclusive."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t.as_py() or "")] for t in texts],
            pa.list_(_SPAN),
        )

    return spans(text.cast("string"))


def redacted(text: Column) -> Column:
    """The text with each stretch of personal data replaced by the kind that starts first, as ``<EMAIL>``."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        return pa.array([t if (t := x.as_py()) is None else redact(t) for x in texts], pa.string())

    return replaced(text.cast("string"))


def redact(text: str) -> str:
    out, done = [], 0
    for start, end, kind in find_spans(text):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return text if not out else "".join([*out, text[done:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans for each document. Missing texts are empty; repeated rows each get a row; other columns
    are left aside."""
    return docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col)).alias("spans"))


def scrub(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced in their texts; ``n_chars`` follows where there is one.

    Every row stays, with the columns of ``docs``, whatever others there are. A null text stays null with its ``n_chars``, an
    empty one empty; repeated rows come out equal; very long texts are replaced whole. Without rows the result is empty.
    """
    out = docs.withColumn(text_col, redacted(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length(text_col).cast("long"), F.col("n_chars")))
    return out


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
    )
