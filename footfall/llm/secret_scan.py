"""Secrets in texts: fixed patterns, and random strings by a battery of randomness tests.

A run of encoding characters is a candidate. Its encoding is inferred from the characters it uses; chi-squared
uniformity, runs and serial correlation test whether it could be random in that encoding. What passes gets a
p-value against ordinary text: under the text's character frequencies, a string that is L times likelier to be
random turns up with probability 1 / L at most, so long strings earn small values. A false-discovery bound
over the candidates of all documents, one for each class of lengths, decides which are reported.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.texts import save, text_bytes

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")

#: Parts of a run without the separators of base64url, of base64, and of both.
_PARTS = [re.compile(f"[A-Za-z0-9{more}]{{16,}}") for more in ("+/", "_-", "")]

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest; a run has the first that holds all its characters.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "lower": _DIGITS + _LOWER,
    "alnum": _DIGITS + _LOWER + _UPPER,
    "base64": _DIGITS + _LOWER + _UPPER + "+/",
    "base64url": _DIGITS + _LOWER + _UPPER + "-_",
}
_SETS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}
_VALUES = {name: {c: k for k, c in enumerate(chars)} for name, chars in ENCODINGS.items()}

_MIXED = ("alnum", "base64", "base64url")

#: Least lengths of the length classes.
LENGTHS = (16, 24, 32, 48, 96)
#: A random string fails the battery with this probability.
REJECT = 0.001
#: Bound on the share of false reports in each class of lengths.
FALSE_SHARE = 0.01
_DEEPEST = 60


def _tail(z: float) -> float:
    """Probability that a normal value is larger."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(counts: list[int], size: int, n: int) -> float:
    """Upper tail of the chi-squared statistic of uniformity, by the Wilson-Hilferty approximation."""
    expected = n / size
    statistic = sum((c - expected) ** 2 for c in counts) / expected + (size - len(counts)) * expected
    free = size - 1
    return _tail(((statistic / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))


def runs_p(values: np.ndarray, size: int) -> float:
    """Two-sided Wald-Wolfowitz test of runs above and below the alphabet's middle."""
    high = values >= size // 2
    a, n = int(high.sum()), len(high)
    b = n - a
    if a == 0 or b == 0:
        return 2 * 0.5**n
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * a * b / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * _tail(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_p(values: np.ndarray) -> float:
    """Two-sided test of the correlation of neighbours."""
    x = values - values.mean()
    spread = float((x * x).sum())
    if spread == 0:
        return 0.0
    n = len(x)
    r = float((x[1:] * x[:-1]).sum()) / spread
    return min(1.0, 2 * _tail(abs(r + 1 / n) * math.sqrt(n)))


def random_p(run: str, encoding: str) -> float:
    """Fisher's combination of the three tests."""
    size, n = len(ENCODINGS[encoding]), len(run)
    table = _VALUES[encoding]
    values = np.array([table[c] for c in run], np.float64)
    parts = (chi_squared_p(list(Counter(run).values()), size, n), runs_p(values, size), serial_p(values))
    x = -2 * sum(math.log(max(p, 1e-300)) for p in parts)
    half = x / 2
    return math.exp(-half) * (1 + half + half * half / 2)  # chi-squared with six degrees of freedom


def encoding_of(run: str) -> str | None:
    chars = set(run)
    return next((name for name, held in _SETS.items() if chars <= held), None)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost, not overlapping within a kind; matches that fail their condition are dropped."""
    found = []
    lowered = text.lower()
    if any(cue in lowered for cue in _CUES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _parts(run: str) -> list[tuple[int, int]]:
    """Places of the parts of a run that have an encoding: the run, or where it mixes the separators of two
    encodings, what stands between those of either and of both."""
    if encoding_of(run) is not None:
        return [(0, len(run))]
    return sorted({m.span() for part in _PARTS for m in part.finditer(run)})


def candidates(text: str, surprise: dict[str, float]) -> list[tuple[int, int, int]]:
    """(start, end, depth) of all tested runs; depth is minus log10 of the p-value against text, and 0 where this is
    no more than a tenth, the battery rejects the run or a deeper part overlaps it.

    Numbers are not secrets by themselves and are left out.
    """
    found = []
    for m in _RUN.finditer(text):
        tested = []
        for start, end in _parts(m[0]):
            run = m[0][start:end]
            encoding = encoding_of(run)
            if encoding == "decimal":
                continue
            gain = sum(surprise[c] for c in run) - len(run) * math.log10(len(ENCODINGS[encoding]))
            if encoding in _MIXED:
                gain += math.log10(2) * sum(c.isalpha() for c in run)  # where case is random, it doubles the alphabet
            passed = gain >= 1 and random_p(run, encoding) >= REJECT
            tested.append((gain if passed else 0, m.start() + start, m.start() + end))
        held: list[tuple[int, int]] = []
        for gain, start, end in sorted(tested, key=lambda t: (-t[0], t[1])):
            alone = all(end <= s or start >= e for s, e in held)
            if gain and alone:
                held.append((start, end))
            found.append((start, end, min(_DEEPEST, int(gain)) if alone else 0))
    return sorted(found)


def _surprise(docs: DataFrame, text_col: str) -> dict[str, float]:
    """Minus log10 of each encoding character's share among the encoding characters of all texts; a letter's
    cases count as one, as a text in capitals is not random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256)), pa.array(total)], names=["byte", "n"])

    texts = text_bytes(docs.select(F.lit(None).alias("doc_id"), F.col(text_col).alias("text")))
    rows = texts.select("text").mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = {chr(r.byte): r.n for r in rows if r.byte < 128}
    share = {c: counts.get(c, 0) + 1 for c in _DIGITS + "+/-_"}
    share |= {c: counts.get(c, 0) + counts.get(c.upper(), 0) + 1 for c in _LOWER}
    total = sum(share.values())
    return {c: -math.log10(share[c.lower()] / total) for c in [*share, *_UPPER]}


FOUND = "array<struct<kind:string,start:int,end:int,depth:int>>"
_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())])


def _found(text: Column, surprise: dict[str, float]) -> Column:
    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for item in texts:
            own = item.as_py() or ""
            row = [{"kind": k, "start": s, "end": e, "depth": None} for s, e, k in base_spans(own)]
            row += [{"kind": "random", "start": s, "end": e, "depth": d} for s, e, d in candidates(own, surprise)]
            rows.append(row)
        return pa.array(rows, pa.list_(_FOUND))

    return found(text.cast("string"))


def _length_class(span: Column) -> Column:
    size = span["end"] - span["start"]
    return sum(((size >= least).cast("int") for least in LENGTHS), F.lit(0)) - 1


def _limits(found: DataFrame) -> list[int]:
    """Per class of lengths, the least depth reported, by the Benjamini-Hochberg rule on whole depths.

    All tested runs of all documents are counted by class and depth: a table of bounded size.
    """
    spans = found.select(F.explode("found").alias("s")).where("s.kind = 'random'")
    counts = (
        spans.select(_length_class(F.col("s")).alias("class"), F.col("s.depth").alias("depth"))
        .groupBy("class", "depth").agg(F.count("*").alias("n")).collect()
    )
    limits = []
    for number in range(len(LENGTHS)):
        own = {r.depth: r.n for r in counts if r["class"] == number}
        tested = sum(own.values())
        limit, reached = _DEEPEST + 1, 0
        for depth in range(_DEEPEST, 0, -1):
            reached += own.get(depth, 0)
            if reached and 10.0**-depth <= FALSE_SHARE * reached / tested:
                limit = depth
        limits.append(limit)
    return limits


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end; by start, then kind as listed) for each document.

    Missing texts are empty; repeated rows each get a row, and count in the false-discovery bound; other columns
    are left aside.
    """
    surprise = _surprise(docs, text_col)
    found = save(docs.select(F.col(id_col).alias("doc_id"), _found(F.col(text_col), surprise).alias("found")), "secrets")
    limits = F.array(*map(F.lit, _limits(found)))
    kept = F.filter(
        "found", lambda s: (s["kind"] != "random") | (s["depth"] >= F.get(limits, _length_class(s)))
    )
    order = F.array_sort(
        F.transform(
            kept,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"),
                s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
    )
    return found.select("doc_id", order.alias("spans"))
