"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item gives windows of consecutive words. Each window is a set of three-word shingles, ordered by
rarity among all documents; as containment has to be whole, its prefix is one shingle, the rarest. Documents
meet windows only on prefix shingles; length and position bounds come next, then a word-by-word comparison.
The benchmark joins in blocks of bounded size, so each broadcast has a proven bound whatever the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.texts import alnum_tokens, bind, opened, save, share, text_bytes, windows

SHINGLE = 3
#: Bytes of benchmark text in a block that is broadcast.
BLOCK_BYTES = 4 << 20
#: Candidate positions compared at once.
_AT_ONCE = 200_000


@dataclass
class Index:
    """Windows of one block of items. Words are numbered; ``-1`` is every other word."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    #: Per window length: word numbers (one row for each window), and the items that hold the window.
    words: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, list[list[str]]] = field(default_factory=dict)
    #: Per shingle length: prefix shingles, sorted, with window length, window and place of the shingle in it.
    prefixes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def numbers(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        parts = [
            np.fromiter((get(w, -1) for w in words), np.int64, len(words)) for words in alnum_tokens(text)
        ]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles_of(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of ``size`` known words."""
    count = len(numbers) - size + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = numbers[:count].copy()
    for k in range(1, size):
        known |= numbers[k : count + k]  # negative where any of them is
    places = np.flatnonzero(known >= 0)
    runs = numbers[places[:, None] + np.arange(size)].astype(np.uint64) + np.uint64(1)
    return places, windows(runs.T, size)[0] if len(places) else np.empty(0, np.uint64)


def _windows_of(items: list[tuple[str, bytes]], size: int) -> Index:
    index = Index()
    groups: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = [w for part in alnum_tokens(text) for w in part]
        numbers = [index.vocabulary.setdefault(w, len(index.vocabulary)) for w in words]
        length = min(size, len(numbers))
        for start in range(len(numbers) - length + 1 if numbers else 0):
            groups[length][tuple(numbers[start : start + length])].add(item_id)
    for length, found in groups.items():
        index.words[length] = np.array(list(found), np.int64)
        index.items[length] = [sorted(x) for x in found.values()]
    return index


def _shingle_size(length: int) -> int:
    return SHINGLE if length >= SHINGLE else 1


def _elements(index: Index) -> dict[int, np.ndarray]:
    """Per shingle length, all shingles of the block's windows, sorted."""
    found: dict[int, list] = defaultdict(list)
    for length, rows in index.words.items():
        size = _shingle_size(length)
        found[size] += [shingles_of(row, size)[1] for row in rows]
    return {size: np.unique(np.concatenate(parts)) for size, parts in found.items()}


def _rarity(texts: DataFrame, index: Index, elements: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each element occurs in all documents; as many numbers as the block has shingles."""
    shared = share(texts.sparkSession, (index, elements))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, elements = opened(shared)
        sums = {size: np.zeros(len(e), np.int64) for size, e in elements.items()}
        for batch in batches:
            for text in batch.column("text"):
                numbers = index.numbers(text.as_py())
                for size, own in elements.items():
                    hashes = shingles_of(numbers, size)[1]
                    at = np.searchsorted(own, hashes).clip(max=len(own) - 1)
                    np.add.at(sums[size], at[own[at] == hashes], 1)
        for size, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), size)), pa.array(some), pa.array(total[some])],
                names=["size", "element", "n"],
            )

    counted = (
        texts.select("text")
        .mapInArrow(run, "size long, element long, n long")
        .groupBy("size", "element")
        .agg(F.sum("n").alias("n"))
    )
    totals = {size: np.zeros(len(e), np.int64) for size, e in elements.items()}
    for row in counted.toLocalIterator():
        totals[row.size][row.element] = row.n
    shared.destroy()
    return totals


def _prefixes(index: Index, elements: dict[int, np.ndarray], rarity: dict[int, np.ndarray]) -> None:
    found: dict[int, list[tuple]] = defaultdict(list)
    for length, rows in index.words.items():
        size = _shingle_size(length)
        for number, row in enumerate(rows):
            hashes = shingles_of(row, size)[1]
            seen = rarity[size][np.searchsorted(elements[size], hashes)]
            place = min(range(len(hashes)), key=lambda k: (seen[k], hashes[k]))
            found[size].append((hashes[place], length, number, place))
    for size, postings in found.items():
        postings.sort()
        keys = np.array([p[0] for p in postings], np.uint64)
        index.prefixes[size] = keys, np.array([p[1:] for p in postings], np.int64)


def occurrences(index: Index, numbers: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """Per item, the stretches of words (from, to exclusive) that its windows cover."""
    covered: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for size, (keys, postings) in index.prefixes.items():
        places, hashes = shingles_of(numbers, size)
        low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        some = np.flatnonzero(high > low)
        for part in np.array_split(some, max(1, int((high - low)[some].sum()) // _AT_ONCE)):
            counts = (high - low)[part]
            which = np.repeat(low[part], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            length, window, place = postings[which].T
            start = np.repeat(places[part], counts) - place
            fits = (start >= 0) & (start + length <= len(numbers))
            for each in np.unique(length[fits]):
                at = np.flatnonzero(fits & (length == each))
                same = (numbers[start[at][:, None] + np.arange(each)] == index.words[each][window[at]]).all(axis=1)
                for begin, number in zip(start[at][same].tolist(), window[at][same].tolist(), strict=True):
                    for item in index.items[each][number]:
                        covered[item].append((begin, begin + int(each)))
    return {item: _merged(spans) for item, spans in covered.items()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


SPANS = "array<struct<item_id:string,start:long,end:long>>"
_SPAN = pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _search(texts: DataFrame, index: Index) -> DataFrame:
    shared = share(texts.sparkSession, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = opened(shared)
        for batch in batches:
            n_words, spans = [], []
            for text in batch.column("text"):
                numbers = index.numbers(text.as_py())
                n_words.append(len(numbers))
                spans.append(
                    [
                        {"item_id": item, "start": start, "end": end}
                        for item, stretches in sorted(occurrences(index, numbers).items())
                        for start, end in stretches
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"),
                    pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN)),
                ],
                names=["doc_id", "text_hash", "n_words", "spans"],
            )

    return texts.mapInArrow(run, f"doc_id long, text_hash long, n_words long, spans {SPANS}")


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about BLOCK_BYTES. Repeated rows of an item are one, so no block grows with their number."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    items = save(rows.distinct(), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // BLOCK_BYTES + 1
    for block in range(count):
        rows = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r.item_id, bytes(r.text)) for r in rows.toLocalIterator()]


def covered_words(spans: Column) -> Column:
    """Words in any of the spans."""
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(
        ordered,
        state,
        lambda seen, s: F.struct(
            F.greatest(seen["end"], s["end"]).alias("end"),
            (seen["total"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(seen["end"], s["start"]))).alias("total"),
        ),
        lambda seen: seen["total"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, spans (per item and stretch of words), contaminated.

    A word is hit inside an occurrence of a window of ``size`` words of an item, or of a whole shorter item. A
    document is contaminated when at least one in ``share`` of its words is hit. Missing texts have no words;
    items without words match nothing; repeated items and rows are kept; other columns are left aside.
    """
    texts = text_bytes(docs).withColumn("text_hash", F.xxhash64("text"))
    whole, more = None, None
    for items in _blocks(benchmark):
        index = _windows_of(items, size)
        elements = _elements(index)
        _prefixes(index, elements, _rarity(texts, index, elements) if elements else {})
        found = _search(texts, index)
        if whole is None:
            whole = found
        else:
            found = found.where(F.size("spans") > 0).select("doc_id", "text_hash", "spans")
            more = found if more is None else more.unionByName(found)
    if more is not None:
        added = more.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("added"))
        same = whole["doc_id"].eqNullSafe(added["doc_id"]) & (whole["text_hash"] == added["text_hash"])
        whole = whole.join(added, same, "left").select(
            whole["doc_id"], whole["text_hash"], whole["n_words"],
            F.concat(whole["spans"], F.coalesce(added["added"], F.array().cast(SPANS))).alias("spans"),
        )
    return whole.select(
        "doc_id",
        "text_hash",
        "n_words",
        covered_words(F.col("spans")).alias("n_hit"),
        F.size(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))).cast("long").alias("n_items"),
        "spans",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with the columns of ``docs``, whatever their names.

    A null or empty text holds no item and stays. Rows that repeat an id are judged by their own texts; rows that
    are repeated whole stay or go together. Very long texts are texts like others. Without rows the result is empty; without
    items nothing goes.
    """
    bad = contamination(docs, benchmark).where("contaminated").select(F.struct("doc_id", "text_hash").alias("bad")).distinct()
    text = F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64(text) == F.col("bad.text_hash"))
    return docs.select(F.struct("*").alias("row")).join(bad, same, "left_anti").select("row.*")


def items_digest(spans: Column) -> Column:
    """SHA-256 of the items that occur, sorted as strings and joined by commas."""
    items = bind(F.transform(spans, lambda s: s["item_id"]), lambda x: F.sort_array(F.array_distinct(x)))
    return F.sha2(F.concat_ws(",", items), 256)
