"""Quality rules: what a text repeats in itself, and lines its host repeats across documents.

Only DataFrame functions: per-text counts stay inside a row (no shuffle); lines are hashed and counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.texts import LOWER, SPACES, UPPER, bind, blank_words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """Limits of the cross-document rule.

    A normalised line is boilerplate of its host when enough different texts of the host hold it: ``limits`` are
    (least words of the line, texts), the first that fits counts, and they don't depend on the size of the host. Short lines
    recur by chance, so they need more. A document is depleted when its boilerplate lines leave fewer than
    ``min_words`` words or less than ``min_left`` of its words.
    """

    limits: tuple[tuple[int, int], ...] = ((20, 20), (5, 50), (0, 1000))
    min_words: int = 10
    min_left: float = 0.3


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five words that the text has twice or more."""

    def covered(starts: Column) -> Column:
        """Words under windows at these ascending starts."""
        steps = F.transform(
            starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def twice(ordered: Column) -> Column:
        """Starts whose window has an equal neighbour in the order of windows."""
        same = F.filter(
            ordered,
            lambda x, i: (F.get(ordered, i + 1)["w"].eqNullSafe(x["w"]))
            | (F.when(i > 0, F.get(ordered, i - 1)["w"]).eqNullSafe(x["w"])),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def counted(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            bind(ordered, lambda o: bind(twice(o), covered))
        )

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        bind(
            F.transform(
                F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
                lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
            ),
            counted,
        )
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def _normal(line: Column) -> Column:
    """Trimmed, A-Z lower-cased, every digit a 0."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER + "123456789", LOWER + "0" * 9)


def _line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns the rules read: rows equal in all of them get equal verdicts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("body"),
    )


KEY = ("doc_id", "host", "text_hash")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return (
        left["doc_id"].eqNullSafe(right["doc_id"])
        & (left["host"] == right["host"])
        & (left["text_hash"] == right["text_hash"])
    )


def line_table(docs: DataFrame) -> DataFrame:
    """Each line of each row: key, place, hash of the normalised line and its words. Written once, read by both rules."""
    at = F.posexplode(
        F.transform(
            _lines(F.col("body")),
            lambda line: F.struct(_line_hash(line).alias("line"), F.size(blank_words(line)).cast("long").alias("words")),
        )
    )
    held = _keyed(docs).select(*KEY, at.alias("place", "at")).select(*KEY, "place", "at.line", "at.words")
    return Scratch(docs.sparkSession, "quality").save(held, "lines")


def boilerplate(lines: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """(host, line): hashes of normalised lines above the limits of their host.

    Documents count by different text, so copies of one document don't make its lines boilerplate. All counts
    are combined before they are shuffled; no key needs its rows together.
    """
    counts = (
        lines.select("host", "text_hash", "line", "words")
        .distinct()
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_documents"), F.max("words").alias("words"))
    )
    limit = F.coalesce(*(F.when(F.col("words") >= words, F.lit(texts)) for words, texts in rules.limits))
    return counts.where(F.col("n_documents") >= limit).select("host", "line")


def removals(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Key of each document with boilerplate lines, their hashes and the words under them."""
    held = line_table(docs)
    return (
        held.join(boilerplate(held, rules), ["host", "line"])
        .dropDuplicates([*KEY, "place"])  # of rows that are repeated whole
        .groupBy(*KEY)
        .agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed_lines"))
    )


def assess(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row for each document: counts within the text, boilerplate words, and the verdict.

    Needs ``doc_id``, ``text`` and ``source``; a missing text is empty, a missing source one host of its own.
    Empty texts fail (no ten words). Repeated rows each get a row. Other columns are left aside.
    """
    body = F.col("body")
    words = F.col("words")
    solid = F.translate(body, SPACES, "")
    counted = (
        _keyed(docs)
        .select(
            *KEY,
            bind(
                blank_words(body),
                lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")),
            ).alias("words"),
            F.char_length(solid).alias("word_chars"),
            (F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
            bind(_lines(body), lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        )
        .select(
            *KEY,
            *(
                c.cast("long")
                for c in (
                    words["n_words"], F.col("word_chars"), F.col("n_symbols"),
                    F.col("n_dup_lines"), words["n_repeat_words"],
                )
            ),
        )
        .toDF(*KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        .withColumn(
            "base_failed",
            (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        )
    )
    gone = removals(docs, rules)
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        counted.join(gone, same_row(counted, gone), "left")
        .select(
            *(counted[c] for c in counted.columns),
            F.coalesce(gone["n_removed_words"], F.lit(0)).cast("long").alias("n_removed_words"),
            gone["removed_lines"],
        )
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & ((F.col("n_removed_words") == 0) | ((left >= rules.min_words) & (left >= rules.min_left * F.col("n_words")))),
        )
    )


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents the rules keep, without their host's boilerplate lines; the columns stay as they are, whatever others there are.

    A null or empty text is rejected (no ten words); a null source is one host of its own; ``n_chars`` is counted anew where a
    line went. Rows that are repeated whole share a verdict and all stay or go. Very long texts are texts like others. Without
    rows the result is empty.
    """
    verdicts = (
        assess(docs, rules).where("kept").select(*KEY, "removed_lines").dropDuplicates(list(KEY))
    )
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
    )
    kept = rows.join(verdicts, same_row(rows, verdicts)).select("doc", "removed_lines")
    text = F.col("doc")["text"]
    cleaned = F.when(F.col("removed_lines").isNull(), text).otherwise(
        F.array_join(
            F.filter(
                F.split(text, "\n"), lambda line: ~F.array_contains(F.col("removed_lines"), _line_hash(line))
            ),
            "\n",
        )
    )
    out = kept.select("doc", cleaned.alias("cleaned"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("cleaned").alias("text"))
        elif name == "n_chars":
            changed = F.col("cleaned") != text
            columns.append(
                F.when(changed, F.char_length("cleaned").cast("long"))
                .otherwise(F.col("doc")["n_chars"]).alias("n_chars")
            )
        else:
            columns.append(F.col("doc")[name].alias(name))
    return out.select(*columns)
