"""Language-model scores by online logistic context mixing.

The model predicts a text bit by bit. A text is units (what stands between spaces), each closed by a space, the
last by an end mark. Hashed contexts (the last byte, the last two, the last three, the unit so far) each keep
counts of the bits seen after them; a mixer adds their log-odds under weights gated by bit position and by how
much two of the contexts have seen, updated online; an adaptive map of (last byte, mixed probability) refines
the result. Bits of a text are minus the log2 of the probabilities of its bits.

Learning gathers every distinct unit of all learning texts with its count (it grows with the corpus), sums the
bit counts of all of them by context slot, and trains mixer and map on all of them, each unit without its own
occurrence. Slots and weights are of fixed size, and so is what is sent to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.texts import blank_tokens, mixed, opened, save, share

SPACE, END = 0x20, 0xFF  # no UTF-8 text holds the byte 0xFF
#: log2 of the slots of each context: last byte, last two, last three, unit so far.
SLOT_BITS = (16, 18, 20, 21)
_FIRST = np.append(0, np.cumsum([1 << b for b in SLOT_BITS])).astype(np.int64)
INPUTS = len(SLOT_BITS)
LEVELS = 4  # how much a context has seen: nothing, up to 2, up to 16, more
GATES = 8 * LEVELS * LEVELS
MAP_STEPS = 32
#: Bytes of units handled at once.
CHUNK = 1 << 14
#: A token or unit with at least this share of all occurrences is common: there are at most so many.
COMMON = 500_000
#: Frequent units, of at most so many bytes, have their costs computed once for all tasks: there are at most so many.
FREQUENT, FREQUENT_BYTES = 200_000, 64
#: Other units a worker remembers; new units, and units of texts, it gathers before it looks at them.
REMEMBERED = 200_000
NEW, GATHERED = 100_000, 2_000_000
#: Units a task counts bits of: each task sends nearly all slots, so few tasks send less.
TASK_UNITS = 1_000_000
_SALTS = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))
_ROOT = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def units_of(text: bytes) -> list[bytes]:
    """The text's units with what closes them; joined they are the text and one end mark."""
    units = text.split(b" ")
    last = units.pop() + b"\xff"
    return [*[u + b" " for u in units], last]


def _contexts(units: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """For all bytes of the units in a row: the bytes, what each context holds before them, and a hash of the
    unit up to and with the byte; and the units' lengths."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.frombuffer(b"".join(units), np.uint8)
    starts = np.cumsum(lengths) - lengths
    total = len(flat)
    place = np.arange(total) - np.repeat(starts, lengths)
    one = np.empty(total, np.uint64)  # before a unit stands a space
    one[0], one[1:] = SPACE, flat[:-1]
    one[starts] = SPACE
    two = np.zeros(total, np.uint64)
    two[1:] = one[:-1]
    two[place == 0] = 0
    three = np.zeros(total, np.uint64)
    three[1:] = two[:-1]
    three[place <= 1] = 0
    powers = np.cumprod(np.full(total, _ROOT))
    undo = np.cumprod(np.full(total, _INVERSE))
    sums = np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers)
    before = np.concatenate([[np.uint64(0)], sums[:-1]])
    earlier, undone = np.repeat(before[starts], lengths), np.repeat(undo[starts], lengths)
    so_far = (before - earlier) * undone
    contexts = (one, one | (two << np.uint64(8)), one | (two << np.uint64(8)) | (three << np.uint64(16)), so_far)
    return flat, contexts, (sums - earlier) * undone, lengths


def _slots(flat: np.ndarray, contexts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bits of the bytes: slots (one row for each context), bits, and last bytes."""
    total, one = len(flat), contexts[0]
    nodes = np.empty((total, 8), np.uint8)  # the byte's bits so far, with a leading one
    for k in range(8):
        nodes[:, k] = (flat >> (8 - k)) | (1 << k)
    salts = _SALTS[nodes]
    bits = ((flat[:, None] >> np.arange(7, -1, -1, dtype=np.uint8)) & 1).astype(np.int64)
    slots = np.empty((INPUTS, total * 8), np.int64)
    slots[0] = ((one << np.uint64(8))[:, None] | nodes).ravel()
    for j in range(1, INPUTS):
        hashed = salts ^ (contexts[j] * np.uint64(0x9E3779B97F4A7C15))[:, None]
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed >>= np.uint64(64 - SLOT_BITS[j])
        hashed += np.uint64(_FIRST[j])
        slots[j] = hashed.ravel()
    return slots, bits.ravel(), np.repeat(one.astype(np.int64), 8)


def _bits(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all bits of the units in a row: slots (one row for each context), bits, and last bytes."""
    flat, contexts, _, _ = _contexts(units)
    return _slots(flat, contexts)


def _chunks(units: list, size_of) -> Iterator[list]:
    """Runs of units of about CHUNK bytes."""
    first = size = 0
    for k, unit in enumerate(units):
        size += size_of(unit)
        if size >= CHUNK:
            yield units[first : k + 1]
            first, size = k + 1, 0
    if first < len(units):
        yield units[first:]


@dataclass
class Model:
    """Log-odds and levels by slot, mixer weights by gate, and the map's log-odds by (last byte, step)."""

    odds: np.ndarray
    level: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def cost(self, units: list[bytes]) -> np.ndarray:
        """Bits of each unit. What units of a chunk begin with alike is looked at once, so sorted ones cost least."""
        out = np.empty(len(units))
        done = 0
        for chunk in _chunks(units, len):
            flat, contexts, upto, lengths = _contexts(chunk)
            _, first, at = np.unique(upto, return_index=True, return_inverse=True)
            slots, bits, last = _slots(flat[first], tuple(c[first] for c in contexts))
            odds = _mixed(self.odds.take(slots), self.weights, _gates(self.level, slots))
            odds = _final(odds, self.refined, last)
            parts = (1 + np.exp(np.where(bits == 1, -odds, odds))).reshape(-1, 8)  # each at most 1 + exp(14)
            parts = parts[:, :4] * parts[:, 4:]
            parts = parts[:, :2] * parts[:, 2:]
            byte_cost = np.log2(parts[:, 0] * parts[:, 1])
            out[done : done + len(chunk)] = np.add.reduceat(byte_cost[at], np.cumsum(lengths) - lengths)
            done += len(chunk)
        return out


def _gates(level: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Bit position, and how much the longest two contexts have seen."""
    position = np.arange(8) * LEVELS
    return ((level.take(slots[2]).reshape(-1, 8) + position) * LEVELS + level.take(slots[3]).reshape(-1, 8)).ravel()


def _mixed(inputs: np.ndarray, weights: np.ndarray, gates: np.ndarray) -> np.ndarray:
    total = weights[:, INPUTS].take(gates)  # the bias
    for j in range(INPUTS):
        total += weights[:, j].take(gates) * inputs[j]
    return np.clip(total, -12, 12, out=total)


def _step(odds: np.ndarray) -> np.ndarray:
    """The map's step nearest to log-odds between -12 and 12."""
    return ((odds + 12) * ((MAP_STEPS - 1) / 24) + 0.5).astype(np.int64)


def _final(odds: np.ndarray, refined: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Log-odds halfway between the mixed and the refined."""
    return np.clip((odds + refined.ravel()[last * MAP_STEPS + _step(odds)]) / 2, -14, 14)


def _odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def _level(seen: np.ndarray) -> np.ndarray:
    return ((seen > 0).astype(np.int8) + (seen > 2) + (seen > 16)).astype(np.int8)


def learning(doc_id: Column) -> Column:
    """Whether a document is learnt from: all but those whose crc32(id as text) leaves 2 on division by 7.

    A missing id counts as an empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def gather_units(docs: DataFrame) -> DataFrame:
    """(unit, n): every distinct unit of the learning texts, from a written table; counts are combined first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(units_of(text.as_py()))
                if len(counts) > COMMON:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    texts = docs.where(learning(F.col("doc_id"))).select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    )
    found = texts.mapInArrow(run, "unit binary, n long")
    return save(found.groupBy("unit").agg(F.sum("n").alias("n")), "units")


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"]
    )


def count_tokens(units: DataFrame) -> DataFrame:
    """(token, c): counts of the lower-cased words in the units, from a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for unit, n in zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for words in blank_tokens(unit.removesuffix(b"\xff")):
                    for word in words:
                        counts[word] += n
            yield _counted(counts)

    found = units.mapInArrow(run, "unit binary, n long")
    return save(found.groupBy(F.col("unit").alias("token")).agg(F.sum("n").alias("c")), "tokens")


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Chunks of units with the weight of each of their bits."""
    for batch in batches:
        pairs = list(zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True))
        for chunk in _chunks(pairs, lambda pair: len(pair[0])):
            units = [u for u, _ in chunk]
            n = np.array([n for _, n in chunk], np.float64)
            yield units, np.repeat(n, 8 * np.fromiter(map(len, units), np.int64, len(units)))


def _sorted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, int]]]:
    """Sorted lists of about NEW (unit, n): what many units begin with alike stands together."""
    held: list[tuple[bytes, int]] = []
    for batch in batches:
        held += zip(batch.column("unit").to_pylist(), batch.column("n").to_pylist(), strict=True)
        if len(held) >= NEW:
            yield sorted(held)
            held = []
    yield sorted(held)


def count_bits(units: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen in each slot, over all units with their counts. What units begin with alike is looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * int(_FIRST[-1]))
        for pairs in _sorted_pairs(batches):
            for chunk in _chunks(pairs, lambda pair: len(pair[0])):
                flat, contexts, upto, lengths = _contexts([u for u, _ in chunk])
                _, first, at = np.unique(upto, return_index=True, return_inverse=True)
                n = np.bincount(at, np.repeat(np.array([n for _, n in chunk], np.float64), lengths))
                slots, bits, _ = _slots(flat[first], tuple(c[first] for c in contexts))
                n = np.repeat(n, 8)
                for row in slots:
                    np.add.at(seen, 2 * row + bits, n)
        seen = seen.reshape(-1, 2)
        some = np.flatnonzero(seen.any(axis=1))
        for part in np.array_split(some, max(1, len(some) // 100_000)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)), pa.array(seen[part, 0].astype(np.int64)),
                    pa.array(seen[part, 1].astype(np.int64)),
                ],
                names=["slot", "zeros", "ones"],
            )

    some = units.coalesce(max(1, math.ceil(units.count() / TASK_UNITS)))
    rows = some.mapInArrow(run, "slot int, zeros long, ones long").groupBy("slot").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")
    )
    zeros, ones = np.zeros(int(_FIRST[-1])), np.zeros(int(_FIRST[-1]))
    table = rows.toArrow()  # no more rows than slots
    slots = table.column("slot").to_numpy()
    zeros[slots], ones[slots] = table.column("zeros").to_numpy(), table.column("ones").to_numpy()
    return zeros, ones


def train(units: DataFrame, zeros: np.ndarray, ones: np.ndarray, rate: float = 2.0) -> Model:
    """Mixer weights and the map, learnt online in each task over its units and averaged by their bits.

    A unit's own occurrence is taken out of the counts it is predicted from, so unseen texts are what is fitted.
    """
    start = np.zeros((GATES, INPUTS + 1))
    start[:, :INPUTS] = 0.35
    without = np.column_stack([_odds(ones, np.maximum(zeros - 1, 0)), _odds(np.maximum(ones - 1, 0), zeros)]).ravel()
    levels = _level(zeros + ones - 1)
    shared = share(units.sparkSession, (without, levels, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without, levels, start = opened(shared)
        weights = start.copy()
        trained = np.zeros(GATES)
        seen = np.zeros(256 * MAP_STEPS * 2)
        for chunk, n in _weighted(batches):
            slots, bits, last = _bits(chunk)
            inputs = without.take(2 * slots + bits)
            gates = _gates(levels, slots)
            odds = _mixed(inputs, weights, gates)
            error = n * (bits - squash(odds))
            mass = np.bincount(gates, n, GATES)
            pace = rate / np.maximum(mass, 1)
            for j in range(INPUTS):
                weights[:, j] += pace * np.bincount(gates, error * inputs[j], GATES) / 4
            weights[:, INPUTS] += pace * np.bincount(gates, error, GATES) / 4
            trained += mass
            np.add.at(seen, (last * MAP_STEPS + _step(odds)) * 2 + bits, n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.arange(GATES), GATES + np.arange(256 * MAP_STEPS)])),
                pa.array(np.concatenate([trained, np.zeros(256 * MAP_STEPS)])),
                pa.FixedSizeListArray.from_arrays(
                    pa.array(
                        np.concatenate(
                            [weights * trained[:, None], np.pad(seen.reshape(-1, 2), ((0, 0), (0, INPUTS - 1)))]
                        ).ravel()
                    ),
                    INPUTS + 1,
                ).cast(pa.list_(pa.float64())),
            ],
            names=["row", "mass", "sums"],
        )

    rows = units.mapInArrow(run, "row long, mass double, sums array<double>")
    summed = rows.groupBy("row").agg(
        F.sum("mass").alias("mass"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(INPUTS + 1))
    )
    weights, seen = start, np.zeros((256 * MAP_STEPS, 2))
    for row in summed.collect():  # GATES + 256 * MAP_STEPS rows
        if row.row >= GATES:
            seen[row.row - GATES] = row.s0, row.s1
        elif row.mass > 0:
            weights[row.row] = [row[f"s{j}"] / row.mass for j in range(INPUTS + 1)]
    shared.destroy()
    middle = np.tile(squash(np.arange(MAP_STEPS) * (24 / (MAP_STEPS - 1)) - 12), 256)
    p = (seen[:, 1] + 20 * middle) / (seen.sum(axis=1) + 20)
    refined = stretch(np.clip(p, 1e-7, 1 - 1e-7)).reshape(256, MAP_STEPS)
    return Model(_odds(ones, zeros), _level(zeros + ones), weights, refined)


def frequent_costs(units: DataFrame, model: Model) -> dict[bytes, float]:
    """Bits of the units that occur most, from a written table: nearly every task needs them."""
    rank = F.floor(F.log2("n") * 8)  # counts in steps of a twelfth: at most 512 of them
    short = units.where(F.octet_length("unit") <= FREQUENT_BYTES).withColumn("rank", rank)
    least, held = None, 0
    for row in sorted(short.groupBy("rank").count().collect(), key=lambda r: -r["rank"]):
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["rank"]
    if least is None:
        return {}
    shared = share(units.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for batch in batches:
            found = sorted(batch.column("unit").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(model.cost(found))], names=["unit", "cost"])

    table = short.where(F.col("rank") >= least).select("unit").mapInArrow(run, "unit binary, cost double").toArrow()
    shared.destroy()
    return dict(zip(table.column("unit").to_pylist(), table.column("cost").to_pylist(), strict=True))


class _Numbers(dict):
    """Units by number; a new one gets the next."""

    def __missing__(self, unit: bytes) -> int:
        number = self[unit] = len(self)
        return number


@dataclass
class _Facts:
    """What a text adds up over its units, by number of the unit: bits, words, known words, their log10(c + 1). And words not
    known, one unit's after the other's, with the first one and how many there are."""

    bits: np.ndarray
    words: np.ndarray
    known: np.ndarray
    logs: np.ndarray
    first: np.ndarray
    many: np.ndarray
    rare: list[bytes]

    def moved(self, places: np.ndarray) -> _Facts:
        """With unit k at ``places[k]``."""
        order = np.empty(len(places), np.int64)
        order[places] = np.arange(len(places))
        columns = (self.bits, self.words, self.known, self.logs, self.first, self.many)
        return _Facts(*(c[order] for c in columns), self.rare)

    def extended(self, more: _Facts) -> _Facts:
        joined = [
            np.concatenate([mine, its])
            for mine, its in (
                (self.bits, more.bits), (self.words, more.words), (self.known, more.known), (self.logs, more.logs),
                (self.first, more.first + len(self.rare)), (self.many, more.many),
            )
        ]
        return _Facts(*joined, self.rare + more.rare)

    def batch(self, rows: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        """Sums of each text, given the numbers of its units (one at least), and its words that are not known."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        units = np.concatenate(found)
        starts = np.cumsum(sizes) - sizes
        n_words, n_known, sums, bits = (
            np.add.reduceat(column.take(units), starts) for column in (self.words, self.known, self.logs, self.bits)
        )
        odd = np.flatnonzero(self.many.take(units))
        text = np.repeat(np.arange(len(found)), sizes)[odd]
        pairs, times = np.unique(text * len(self.bits) + units[odd], return_counts=True)
        text, units = np.divmod(pairs, len(self.bits))
        many = self.many[units]
        ends = np.cumsum(many)
        words = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[units] - (ends - many), many)
        cuts = np.append(0, np.cumsum(np.bincount(text, many, len(found)))).astype(np.int32)
        rare = pa.array(self.rare, pa.binary()).take(pa.array(words))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("row"), rows.column("doc_id"), pa.array(n_words + 1), pa.array(n_known), pa.array(sums),
                pa.array(bits), pa.array([len(t.as_py()) for t in rows.column("text")], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cuts), rare),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.repeat(times, many))),
            ],
            names=["row", "doc_id", "n_tokens", "n_known", "sums", "bits", "n_bytes", "rare", "times"],
        )


def _facts(units: list[bytes], bits: np.ndarray, known: dict[bytes, int]) -> _Facts:
    """Of units with their costs. Words never reach across units, so counts of words add up too."""
    words = [unit[:-1].lower().split() for unit in units]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    c = np.fromiter((known.get(w, 0) for w in flat), np.float64, len(flat))
    of = np.repeat(np.arange(len(units)), sizes)
    rare = np.flatnonzero(c == 0)
    many = np.bincount(of[rare], minlength=len(units))
    return _Facts(
        bits, sizes, sizes - many, np.bincount(of, np.log10(c + 1), len(units)), np.cumsum(many) - many, many,
        [flat[k] for k in rare.tolist()],
    )


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    ``score`` is the model's log10 probability of the whole text, ``base_score`` that of its lower-cased words
    (and one end) by add-one unigram counts. Missing texts are empty: just an end. Repeated rows count as often
    as they stand; an empty table gives no rows. Other columns are left aside.
    """
    units = gather_units(docs)
    tokens = count_tokens(units)
    texts = units.where(F.substring("unit", -1, 1) == F.lit(bytes([END]))).agg(F.sum("n")).first()[0] or 0
    sizes = tokens.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total = (sizes.n or 0) + texts
    distinct = sizes.v + (1 if texts else 0)
    base = total + distinct + 1
    common = tokens.where(F.col("c") >= max(2, total / COMMON)).collect()  # COMMON rows at most
    model = train(units, *count_bits(units))
    shared = share(docs.sparkSession, (model, {bytes(r.token): r.c for r in common}, frequent_costs(units, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, costs = opened(shared)
        numbers = _Numbers(zip(costs, range(len(costs)), strict=True))
        facts = _facts(list(costs), np.fromiter(costs.values(), np.float64, len(costs)), known)
        frequent = len(costs)  # these come first and stay
        most = facts

        def scored(rows: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal facts
            new = sorted(islice(numbers, len(facts.bits), None))
            places = np.fromiter(map(numbers.__getitem__, new), np.int64, len(new)) - len(facts.bits)
            facts = facts.extended(_facts(new, model.cost(new), known).moved(places))
            made = facts.batch(rows, found)
            if len(numbers) - frequent > REMEMBERED:
                facts = most
                while len(numbers) > frequent:
                    numbers.popitem()  # the last one
            return made

        for batch in batches:
            found, first, size = [], 0, 0
            for k, text in enumerate(batch.column("text")):
                units = units_of(text.as_py())
                found.append(np.fromiter(map(numbers.__getitem__, units), np.int32, len(units)))
                size += len(units)
                if size >= GATHERED or len(numbers) - len(facts.bits) >= NEW:
                    yield scored(batch.slice(first, k + 1 - first), found)
                    found, first, size = [], k + 1, 0
            if found:
                yield scored(batch.slice(first), found)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = save(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        ).mapInArrow(
            run,
            f"row long, doc_id {id_type}, n_tokens long, n_known long, sums double, bits double, n_bytes long,"
            " rare array<binary>, times array<long>",
        ),
        "scored",
    )
    rare = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("tf"))
        .join(tokens, "token")
        .groupBy("row")
        .agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more"))
    )
    ends = np.log10(texts + 1)  # c of the end is the number of learning texts
    known, more = F.coalesce("more_known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id",
        (~learning(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + known + (1 if texts else 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sums") + more + float(ends) - F.col("n_tokens") * float(np.log10(base))).alias("base_score"),
        (F.col("bits") * -float(np.log10(2))).alias("score"),
        "n_bytes",
    )
