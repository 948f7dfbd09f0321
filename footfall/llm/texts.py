"""Helpers the text operators share: words, row keys, written tables, joins with hot keys."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import shared_dir

#: The six ASCII white-space characters: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of alphanumeric words: ASCII digits and letters, and everything beyond ASCII; A-Z lower-cased.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, also where body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between ASCII white space, as an array."""
    return bind(
        F.btrim(text, F.lit(SPACES)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
            F.split(t, "[\\x20\\x09-\\x0D]+")
        ),
    )


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about a MB, cut at white space, so that a long text's words are never all objects."""
    start = 0
    while len(text) - start > PIECE:
        cut = _BLANK.search(text, start + PIECE)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def blank_tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words between ASCII white space, in lists of bounded size."""
    for piece in pieces(text):
        yield piece.lower().split()


def alnum_tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    for piece in pieces(text):
        yield piece.translate(_ALNUM).split()


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


def hashes(lists: Iterator[list[bytes]], known: WordHashes) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in lists]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words."""
    count = len(words) - size + 1
    value = words[:count].copy()
    for k in range(1, size):
        value = value * _ODD + words[k : count + k]
    return mixed(value)


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just id and UTF-8 text (null: empty), whatever other columns there are."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def save(df: DataFrame, what: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends here and executors may go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with at least this share of all rows counts as hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.002


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """Joins rows with a table that has each key once and says how many left rows have it.

    Keys with a share of HOT_SHARE or more of the counted rows are at most 1 / HOT_SHARE many: these few are
    broadcast and their rows never shuffled. The others meet in a shuffle join without hot keys.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) >= max(2, total * HOT_SHARE)).drop(count)
    rest = right.where(F.col(count) < max(2, total * HOT_SHARE)).drop(count)
    return (
        left.join(F.broadcast(hot), key)
        .unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how), allowMissingColumns=True)
    )


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcasts a value of this subpackage's classes, by value as its functions are."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    return pickle.loads(shared.value)


def give_back() -> None:
    """Returns what a task has freed to the system. Workers are reused, and one that waits keeps it otherwise, next to
    the JVM that runs the steps after it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)
