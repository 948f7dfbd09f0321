"""Language identification: known words first, shorter and shorter character runs for the others.

The model holds, for each language, log frequencies of its commonest words and of its commonest runs of one to four
characters (word ends marked). A word of the model scores by its log frequency in each language. For another word, each of
its positions scores by the longest run of the model that starts there, and the word by the mean of its positions. A
text's language has the highest sum over its words.

The model is fitted on a bounded, documented sample of labelled rows, chosen by a hash of the text, about equally many of
each language. Its size depends on the number of languages, not on that of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.texts import opened, pieces, share

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MARK = " "
#: Distinct words a task counts before it hands them on, and words a worker remembers beyond the model's.
_COUNTED = 200_000
_REMEMBERED = 200_000
#: Words whose scores are added at once.
_AT_ONCE = 8192

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangId:
    """``rows``: labelled rows the fit draws for each language, on average. ``words`` and ``runs``: entries of a language's
    table of words, and of those of runs of each size up to ``longest``. A word is known from ``least`` sightings on."""

    rows: int = 5_000
    words: int = 20_000
    runs: int = 10_000
    longest: int = 4
    least: int = 2
    smoothing: float = 0.5


def words_of(text: bytes) -> Iterator[list[str]]:
    """Lower-cased runs of letters, in lists of bounded size."""
    for piece in pieces(text):
        yield _WORD.findall(piece.decode("utf-8", "replace").lower())


def runs_of(word: str, size: int) -> list[str]:
    marked = f"{_MARK}{word}{_MARK}"
    return [marked[k : k + size] for k in range(len(marked) - size + 1)]


def is_held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """A fixed fold of the documents; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def labelled_sample(labelled: DataFrame, rule: LangId) -> DataFrame:
    """(lang, text): about ``rule.rows`` different texts for each language, the same ones in every run."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size")).collect()  # one row a language
    if not sizes:
        return labelled.select("lang", "text")
    share_of = F.create_map(*(F.lit(x) for row in sizes for x in (row["lang"], float(rule.rows << 32) / row["size"])))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    return labelled.where(place < share_of[F.col("lang")]).select("lang", "text").distinct()


def _counts(sample: DataFrame, rule: LangId) -> DataFrame:
    """(lang, size, token, n): sightings of words (size 0) and of runs of characters."""

    def flushed(lang: str, words: Counter) -> pa.RecordBatch:
        found: list[Counter] = [words, *(Counter() for _ in range(rule.longest))]
        for word, n in words.items():
            for size in range(1, rule.longest + 1):
                for run in runs_of(word, size):
                    found[size][run] += n
        rows = [(size, token, n) for size, counter in enumerate(found) for token, n in counter.items()]
        sizes, tokens, counts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(rows)), pa.array(sizes, pa.int32()), pa.array(tokens), pa.array(counts, pa.int64())],
            names=["lang", "size", "token", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counter = held.setdefault(lang, Counter())
                for words in words_of(text.as_py()):
                    counter.update(words)
                if len(counter) > _COUNTED:
                    yield flushed(lang, held.pop(lang))
        for lang, counter in held.items():
            if counter:
                yield flushed(lang, counter)

    rows = sample.mapInArrow(run, "lang string, size int, token string, n long")
    return rows.groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))


class Model:
    """Languages, and for words (size 0) and runs of each size a table of rows with one log frequency a language."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], scores: list[np.ndarray]):
        self.langs, self.tables, self.scores = langs, tables, scores

    def backed_off(self, word: str) -> np.ndarray:
        """The score of a word that is not in the table: the mean over its positions of the longest known run there."""
        marked = f"{_MARK}{word}{_MARK}"
        found = []
        for k in range(len(marked)):
            for size in range(min(len(self.tables) - 1, len(marked) - k), 0, -1):
                row = self.tables[size].get(marked[k : k + size])
                if row is not None:
                    if size > 1 or marked[k] != _MARK:
                        found.append(self.scores[size][row])
                    break
        return np.mean(found, axis=0) if found else np.zeros(len(self.langs))


def fit(labelled: DataFrame, rule: LangId = LangId()) -> Model:
    """A model of rows (lang, text); rows without a lang or text teach nothing."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    scratch = Scratch(rows.sparkSession, "lang-id")
    sample = labelled_sample(rows.where("lang IS NOT NULL AND text IS NOT NULL"), rule)
    counts = scratch.save(_counts(sample, rule), "counts")
    by_rank = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "token")
    limit = F.when(F.col("size") == 0, rule.words).otherwise(rule.runs)
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()
    kept = (
        counts.where((F.col("size") > 0) | (F.col("n") >= rule.least))
        .withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= max(rule.words, rule.runs))  # pruned before the shuffle
        .where(F.col("rank") <= limit)
        .select("lang", "size", "token", "n")
        .toArrow()
    )
    langs = sorted({row["lang"] for row in totals})
    total = {(row["lang"], row["size"]): row["total"] for row in totals}
    number = {lang: k for k, lang in enumerate(langs)}
    tables: list[dict[str, int]] = [{} for _ in range(rule.longest + 1)]
    cells: list[list[tuple[int, int, int]]] = [[] for _ in tables]
    for lang, size, token, n in zip(*(kept.column(c).to_pylist() for c in ("lang", "size", "token", "n")), strict=True):
        cells[size].append((tables[size].setdefault(token, len(tables[size])), number[lang], n))
    scores = []
    for size, (table, found) in enumerate(zip(tables, cells, strict=True)):
        matrix = np.full((len(table), len(langs)), rule.smoothing)
        for row, lang, n in found:
            matrix[row, lang] += n
        whole = np.array([total.get((lang, size), 0) for lang in langs]) + rule.smoothing * len(table)
        scores.append(np.log(matrix / whole) if len(table) else matrix)
    return Model(langs, tables, scores)


class Scorer(dict):
    """Row numbers of words; those of words beyond the model's are computed once and remembered, boundedly."""

    def __init__(self, model: Model):
        self.model, self.known = model, model.tables[0]
        size = len(self.known)
        self.rows = np.empty((size + _REMEMBERED, len(model.langs)))
        self.rows[:size] = model.scores[0]
        super().__init__(self.known)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.rows[row] = self.model.backed_off(word)
        return row

    def total(self, words: list[str]) -> np.ndarray:
        found = np.zeros(len(self.model.langs))
        for start in range(0, len(words), _AT_ONCE):
            if len(self) + _AT_ONCE > len(self.rows):
                self.clear()
                self.update(self.known)
            part = words[start : start + _AT_ONCE]
            found += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return found

    def predict(self, text: bytes | None) -> tuple[str, float]:
        total, some = np.zeros(len(self.model.langs)), False
        for words in words_of(text or b""):
            if words:
                total, some = total + self.total(words), True
        if not some or not self.model.langs:
            return UNDETERMINED, 0.0
        best = int(np.argmax(total))  # ties go to the language that sorts first
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row, by its text alone."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(opened(shared))
        for batch in batches:
            found = [scorer.predict(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, rule: LangId = LangId()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score (the posterior share of the language).

    Learns from rows that are not held out. A null text or one without letters is ``und`` with score 0, as is every text
    where there is nothing to learn from. A text whose every character is unknown gets the language that sorts first.
    Rows that repeat an id are rows like others; repeated texts are learnt from once. Null labels teach nothing. Other columns
    are left aside.
    """
    model = fit(docs.where(~is_held_out(F.col("doc_id"))).select("lang", "text"), rule)
    found = predict(docs, model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
