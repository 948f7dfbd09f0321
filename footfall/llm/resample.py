"""Importance resampling towards a target distribution.

Weights come from arrays: a feature (a run of one to three words) is a bucket, a bucket has a gain, and a document's
weight is the sum of its features' gains. CRC-32 is linear, so the buckets of all runs of a text follow from one value per
word by table look-ups over whole arrays.

A seeded Gumbel number is added to each weight, so that the highest scores are a sample without replacement. Ranks come
from a distributed LSD radix sort: each pass counts the rows of each digit in each block of places, turns the counts into
global offsets by a prefix sum, and sends every row to its destination. Passes are stable, so after the last one a row's
place is its rank. A block has a fixed number of places, so however many rows share a digit, no task gets more than a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.texts import alnum_tokens, text_bytes

#: Bits of a digit, and of a place within its block: at most an eighth as many counts as rows.
DIGIT_BITS = 10
BLOCK_BITS = 13
#: Features that are held before they are added to the counts.
_HELD = 1 << 20


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents with ``min_words`` words or more are drawn."""

    buckets: int = 10_000
    longest: int = 3
    min_words: int = 20
    percent: int = 5
    seed: int = 42


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    """The CRC register after one more zero byte."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


def _looked_up(table: np.ndarray, row: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """Each register moved on by what its row of the table stands for."""
    out = table[row, 0, crc & np.uint32(255)]
    for k in range(1, 4):
        out ^= table[row, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class ZeroBytes:
    """Moves CRC-32 registers on by any number of zero bytes, many at once."""

    def __init__(self):
        self.few = np.empty((256, 4, 256), np.uint32)
        self.few[0] = np.arange(256, dtype=np.uint32) << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
        for n in range(1, 256):
            self.few[n] = _zero_byte(self.few[n - 1])
        self.many = np.empty((32, 4, 256), np.uint32)  # 256 bytes, 512, 1,024, ...
        self.many[0] = _zero_byte(self.few[255])
        for k in range(1, 32):
            self.many[k] = _looked_up(self.many, k - 1, self.many[k - 1].ravel()).reshape(4, 256)

    def after(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        moved = _looked_up(self.few, length & 255, crc)
        rest = length >> 8
        for k in range(int(rest.max(initial=0)).bit_length()):
            picked = (rest >> k) & 1 == 1
            moved[picked] = _looked_up(self.many, k, moved[picked])
        return moved


class WordCrcs(dict):
    """CRC-32 of a word, and of a space and the word in the upper half; remembers a bounded number."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) | zlib.crc32(b" " + word) << 32
        if len(self) < self.LIMIT:
            self[word] = value
        return value


class Features:
    """Bucket numbers of a text's runs of words, in arrays of bounded size."""

    def __init__(self, rule: Resampling):
        self.rule, self.known, self.zeros = rule, WordCrcs(), ZeroBytes()

    def buckets(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(words of a piece of the text, buckets of the runs that end in it)."""
        reach = self.rule.longest - 1
        crcs, lengths = np.empty(0, np.uint64), np.empty(0, np.int64)
        for words in alnum_tokens(text):
            before = len(crcs)
            crcs = np.concatenate([crcs, np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))])
            lengths = np.concatenate([lengths, np.fromiter(map(len, words), np.int64, len(words)) + 1])
            run = (crcs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            tail = (crcs >> np.uint64(32)).astype(np.uint32)
            found = [run[before:]]
            for size in range(2, self.rule.longest + 1):
                if len(crcs) < size:
                    break
                # A run's CRC is that of the run without its last word, moved on, and that of a space and the word.
                run = self.zeros.after(run[:-1], lengths[size - 1 :]) ^ tail[size - 1 :]
                found.append(run[max(0, before - size + 1) :])
            yield len(words), np.concatenate(found) % np.uint32(self.rule.buckets)
            keep = len(crcs) - min(reach, len(crcs))
            crcs, lengths = crcs[keep:], lengths[keep:]


def bucket_counts(docs: DataFrame, rule: Resampling = Resampling(), text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket. Each task sends one row per bucket, and the driver gets one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(rule), np.zeros(rule.buckets, np.int64)
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                for _, found in features.buckets(text.as_py()):
                    held.append(found)
                    size += len(found)
                    if size >= _HELD:
                        total += np.bincount(np.concatenate(held), minlength=rule.buckets)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=rule.buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled])], names=["bucket", "n"])

    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(rule.buckets, np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    n_source, n_target, size = int(source.sum()), int(target.sum()), len(source)
    ratio = [
        float(t + 1) * float(n_source + size) / (float(s + 1) * float(n_target + size))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    ]
    return np.array([floor(1000 * log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, rule: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(rule)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n_words = n_features = weight = 0
                for words, found in features.buckets(text.as_py()):
                    n_words += words
                    n_features += len(found)
                    weight += int(gain[found].sum())
                rows.append((n_words, n_features, weight))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return text_bytes(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number that depends on seed and id alone, rounded down; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _counting_pass(rows: DataFrame, digit: Column, scratch: Scratch) -> DataFrame:
    """Rows with new places: by digit, rows of one digit in their old order."""
    dealt = rows.withColumn("digit", digit).withColumn("block", F.shiftright("place", BLOCK_BITS))
    counts = scratch.save(dealt.groupBy("digit", "block").agg(F.count("*").alias("n")), "counts")
    totals = sorted(counts.groupBy("digit").agg(F.sum("n").alias("n")).collect())  # one row per digit
    starts = accumulate((n for _, n in totals), initial=0)
    first = rows.sparkSession.createDataFrame(
        [(k, start) for (k, _), start in zip(totals, starts, strict=False)], "digit long, start long"
    )
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(first), "digit")
    offsets = offsets.select("digit", "block", (F.col("start") + F.col("earlier")).alias("offset"))
    turn = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
    moved = dealt.withColumn("turn", turn).join(offsets, ["digit", "block"])
    placed = scratch.save(moved.select(*rows.drop("place").columns, (F.col("offset") + F.col("turn")).alias("place")), "placed")
    scratch.drop(counts, rows)
    return placed


def radix_places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2... by the keys, which are non-negative longs; the first matters most.

    As many passes as the largest values have digits. Places are written after each pass, so a pass that is run again
    for a lost executor sends every row to where it went before.
    """
    scratch = Scratch(rows.sparkSession, "radix")
    rows = scratch.save(rows.withColumn("place", F.monotonically_increasing_id()), "rows")
    tops = rows.agg(*(F.max(k).alias(k) for k in keys)).first()
    for key in reversed(keys):
        for shift in range(0, max(1, (tops[key] or 0).bit_length()), DIGIT_BITS):
            digit = F.shiftright(F.col(key), shift).bitwiseAND((1 << DIGIT_BITS) - 1)
            rows = _counting_pass(rows, digit, scratch)
    return rows


def resample(docs: DataFrame, target: DataFrame, rule: Resampling = Resampling()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``rank`` is 1, 2, 3... for the drawn documents, by falling score, ties to the smaller doc_id, then to fewer features
    and less weight; null for all others. A null text has no words. A null id draws its number as an empty one and comes
    after all other ids of its score. Rows that repeat an id or a text are rows like others, each with its own rank. Without
    documents the result is empty; without target texts the target is uniform. Other columns are left aside.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, rule), bucket_counts(target, rule))
    scored = weights(docs, gain, rule)
    scored = scratch.save(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), rule.seed)), "scored")
    meant = F.col("n_words") >= rule.min_words
    ends = scored.where(meant).agg(F.count("*"), F.max("score"), F.min("doc_id"), F.max("doc_id"), F.min("weight")).first()
    size, top, low, high, light = (v or 0 for v in ends)
    place = F.col("doc_id")
    parts = {"by_id": F.coalesce(place - low, F.lit(0))}
    if high - low >= 1 << 63:  # ids of both signs, far apart: by their halves
        half = F.shiftright(place, 32) + (1 << 31)
        parts = {
            "by_half": F.coalesce(half, F.lit(0)),
            "by_id": F.coalesce(place.bitwiseAND((1 << 32) - 1), F.lit(0)),
        }
    keys = {"by_score": F.lit(top) - F.col("score"), "no_id": place.isNull().cast("long")} | parts | {
        "by_size": F.col("n_features"),
        "by_weight": F.col("weight") - light,
    }
    if scored.where(meant).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        keys.pop("by_size"), keys.pop("by_weight")  # each id once: score and id decide every place
    named = scored.where(meant).withColumns({k: v.cast("long") for k, v in keys.items()})
    drawn = rule.percent * size // 100
    ranked = radix_places(named, list(keys)).withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.where(~meant).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*names).unionByName(rest.select(*names))


def drawn(docs: DataFrame, target: DataFrame, rule: Resampling = Resampling()) -> DataFrame:
    """The drawn documents with all their columns. Rows that repeat a drawn id all stay: they are one document."""
    ids = resample(docs, target, rule).where("rank IS NOT NULL").select("doc_id").distinct()
    rows, ids = docs.select(F.struct("*").alias("row")), ids.select(F.struct("doc_id").alias("drawn"))
    found = rows.join(ids, F.col("row.doc_id").cast("long").eqNullSafe(F.col("drawn.doc_id")), "left_semi")
    return found.select("row.*")
