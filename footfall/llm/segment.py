"""Sampled SentencePiece segmentations: Gumbel top-k without replacement over the piece lattice.

A text's lattice has a node before each character and an arc for each vocabulary piece; arcs never cross the
start of a word, so the lattice is that of its words in a row. A piece's weight falls with its rank in the
model (Zipf), and a path's probability is the product over its pieces, normalised by a backward pass.

Paths come out in the order of their Gumbel-perturbed log-probabilities. The first is drawn arc by arc, which
is the path that has the largest perturbed value of all. The paths that differ from it first at some word form
one open set for each word; a set's best perturbed value is a Gumbel truncated at that of its parent. The A*
search pops the best open set, draws a path in it, splits the rest of the set by word again, and so on. All
noise is a hash of the row's key, the place and the round: results don't depend on how rows are batched.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.texts import give_back, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text a task segments at once; a longer text is alone.
SLICE_BYTES = 3 << 19
_END = -1


@dataclass(frozen=True)
class Sampling:
    """``count`` distinct segmentations for each text. ``sharpness`` multiplies the weights: more, and the
    likeliest segmentations win oftener."""

    count: int = 2
    sharpness: float = 1.0
    seed: int = 0


class Vocabulary:
    """Piece ids, weights and a trie, from the bytes of a model file."""

    def __init__(self, model: bytes, sharpness: float):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.get_piece_size()
        usable = [
            (processor.get_score(i), i, processor.id_to_piece(i))
            for i in range(size)
            if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))
        ]
        # Pieces with a word start inside are runs of spaces, which the model never merges into.
        usable = [x for x in usable if MARK not in x[2][1:]]
        usable.sort(reverse=True)
        weights = -np.log(np.arange(len(usable)) + 3.0)
        floor = -math.log(size + 3.0)
        total = np.logaddexp.reduce(np.append(weights, floor + math.log(256)))
        self.weight = np.full(size, -np.inf)
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of = [b""] * size
        for i in range(size):
            if processor.is_byte(i):
                value = int(processor.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
        children: dict[tuple[int, int], int] = {}
        ends = [_END]
        for (_, i, piece), weight in zip(usable, weights, strict=True):
            self.weight[i] = sharpness * (weight - total)
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
            state = 0
            for char in piece:
                key = (state, ord(char))
                if key not in children:
                    children[key] = len(ends)
                    ends.append(_END)
                state = children[key]
            ends[state] = i
        self.byte_weight = sharpness * (floor - total)
        self.ends = np.array(ends, np.int64)
        keys = np.array([(s << 21) | c for s, c in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(children.values()), np.int64)[order]
        # Moves on ASCII characters as a table, for the states that have any move.
        states, chars = self.keys >> 21, self.keys & 0x1FFFFF
        plain = chars < 128
        inner = np.unique(states[plain])
        self.row = np.zeros(len(ends), np.int64)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.moves = np.zeros((len(inner) + 1, 128), np.int32)
        self.moves[self.row[states[plain]], chars[plain]] = self.targets[plain]
        self.first = np.zeros(0x110000, np.int32)  # state after one character from the root; 0 for none
        for (state, char), target in children.items():
            if state == 0:
                self.first[char] = target
        lengths = np.array([len(b) for b in self.bytes_of])
        self.offsets = np.append(0, np.cumsum(lengths))
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The trie's next states; 0 where there is none."""
        out = self.moves[self.row[states], chars & 127].astype(np.int64)
        other = np.flatnonzero(chars > 127)
        key = (states[other] << 21) | chars[other]
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        out[other] = np.where(self.keys[at] == key, self.targets[at], 0)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the word mark before the first word is dropped."""
        if len(ids) == 0:
            return b""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.all_bytes[place].tobytes()[1:]


class Lattice:
    """Nodes, arcs and exact arc probabilities of a set of distinct words, each with the mark in front.

    ``arc`` numbers run per node, longest first; ``low[node]`` to ``low[node + 1]`` are a node's arcs. The words
    of ``base`` come first.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str], base: Lattice | None = None):
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.start = np.append(0, np.cumsum(lengths))  # a word's first node; one node more than arcs need
        total = int(self.start[-1])
        left = np.repeat(self.start[1:], lengths) - np.arange(total)  # characters to the end of the word
        inside = chars.copy()
        marks = chars == ord(MARK)
        marks[self.start[:-1]] = False
        inside[marks] = 0  # a mark in the text itself is spelt in bytes
        found: list[tuple[np.ndarray, np.ndarray]] = []
        alive = np.arange(total)
        states = vocabulary.first[inside].astype(np.int64)
        size = 1
        while True:
            some = states > 0
            alive, states = alive[some], states[some]
            piece = vocabulary.ends[states]
            found.append((alive[piece != _END], piece[piece != _END]))
            longer = left[alive] > size
            alive, states = alive[longer], states[longer]
            if len(alive) == 0:
                break
            states = vocabulary.step(states, inside[alive + size])
            size += 1
        single = np.zeros(total, bool)
        single[found[0][0]] = True
        bare = np.flatnonzero(~single)
        count = np.bincount(np.concatenate([at for at, _ in found]), minlength=total) + ~single
        self.low = np.append(0, np.cumsum(count))
        self.piece = np.empty(self.low[-1], np.int32)
        self.size = np.empty(self.low[-1], np.int32)
        filled = self.low[:-1].copy()
        for length in range(len(found), 0, -1):
            at, piece = found[length - 1]
            self.piece[filled[at]], self.size[filled[at]] = piece, length
            filled[at] += 1
        # The rest is spelt in bytes: one piece, or minus one less than the character for several.
        code = chars[bare]
        self.piece[filled[bare]] = np.where(code < 128, vocabulary.byte_ids[code & 127], -code - 1)
        self.size[filled[bare]] = 1
        weight = vocabulary.weight[np.maximum(self.piece, 0)]
        weight[filled[bare]] = vocabulary.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        node = np.repeat(np.arange(total), count)
        target = node + self.size
        ends = left[node] == self.size
        value = np.zeros(total)
        order = np.argsort(left, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(left[order])[1:]))
        for k in range(len(cuts) - 1):  # nodes with k + 1 characters left: all their targets are done
            nodes = order[cuts[k] : cuts[k + 1]]
            if len(nodes) == 0:
                continue
            n = count[nodes]
            first = np.cumsum(n) - n
            arcs = np.repeat(self.low[nodes] - first, n) + np.arange(n.sum())
            mass = weight[arcs] + np.where(ends[arcs], 0.0, value[np.minimum(target[arcs], total - 1)])
            most = np.maximum.reduceat(mass, first)
            value[nodes] = most + np.log(np.add.reduceat(np.exp(mass - np.repeat(most, n)), first))
        self.logp = weight + np.where(ends, 0.0, value[np.minimum(target, total - 1)]) - value[node]
        probability = np.exp(self.logp)
        before = np.cumsum(probability)
        self.upto = before - np.repeat((before - probability)[self.low[:-1]], count)
        self.upto[self.low[1:] - 1] = 2.0  # the last arc takes what rounding leaves
        if base is not None:
            self.start = np.concatenate([base.start[:-1], self.start + base.start[-1]])
            self.low = np.concatenate([base.low[:-1], self.low + base.low[-1]])
            for name in ("piece", "size", "logp", "upto"):
                setattr(self, name, np.concatenate([getattr(base, name), getattr(self, name)]))

    def draw(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One path for each word: (arcs of all words in a row, arcs per word, log-probabilities)."""
        node = self.start[words]
        end = self.start[words + 1]
        active = np.arange(len(words))
        logp = np.zeros(len(words))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            noise = (mixed(seeds[active] + np.uint64(len(steps) + 1)) >> np.uint64(11)) * 2.0**-53
            arc = self.low[node]
            search = np.flatnonzero(noise >= self.upto[arc])
            while len(search):
                arc[search] += 1
                search = search[noise[search] >= self.upto[arc[search]]]
            logp[active] += self.logp[arc]
            steps.append((active, arc))
            node = node + self.size[arc]
            going = node < end
            active, node, end = active[going], node[going], end[going]
        count = np.zeros(len(words), np.int64)
        for which, _ in steps:
            count[which] += 1
        first = np.cumsum(count) - count
        arcs = np.empty(count.sum(), np.int64)
        for k, (which, arc) in enumerate(steps):
            arcs[first[which] + k] = arc
        return arcs, count, logp

    def path_logp(self, arcs) -> float:
        return float(self.logp[np.asarray(arcs, np.int64)].sum())

    def _taken(self, word: int, taken: list[tuple[int, ...]]) -> list[list[tuple[int, dict[int, int]]]]:
        """The taken paths as a trie: per depth, (node, next entry by arc)."""
        levels, members = [], [(int(self.start[word]), taken)]
        while members:
            level, following = [], []
            for node, paths in members:
                below: dict[int, list] = defaultdict(list)
                for path in paths:
                    if len(path) > len(levels):
                        below[path[len(levels)]].append(path)
                level.append((node, {arc: len(following) + k for k, arc in enumerate(below)}))
                following += [(node + int(self.size[arc]), own) for arc, own in below.items()]
            levels.append(level)
            members = following
        return levels

    def _masses(self, levels) -> list[list[float]]:
        """Probability, from each node of the trie on, of the paths that are not taken; sums without cancellation."""
        out: list[list[float]] = [[] for _ in levels]
        for depth in range(len(levels) - 1, -1, -1):
            for node, following in levels[depth]:
                total = 0.0
                if following:
                    for arc in range(int(self.low[node]), int(self.low[node + 1])):
                        rest = out[depth + 1][following[arc]] if arc in following else 1.0
                        total += math.exp(self.logp[arc]) * rest
                out[depth].append(total)
        return out

    def others(self, word: int, taken: list[tuple[int, ...]]) -> float:
        """Probability of the word's paths that are none of ``taken``."""
        return self._masses(self._taken(word, taken))[0][0]

    def draw_other(self, word: int, taken: list[tuple[int, ...]], noise: Iterator[float]) -> tuple[int, ...] | None:
        """A path of the word that is none of ``taken``, with its probability among the others."""
        levels = self._taken(word, taken)
        masses = self._masses(levels)
        if masses[0][0] <= 0:
            return None
        node, end = int(self.start[word]), int(self.start[word + 1])
        path: list[int] = []
        entry: int | None = 0  # of the trie, while the path follows taken ones
        while node < end:
            depth, arcs = len(path), range(int(self.low[node]), int(self.low[node + 1]))
            following = levels[depth][entry][1] if entry is not None else {}
            weights = [
                math.exp(self.logp[arc]) * (masses[depth + 1][following[arc]] if arc in following else 1.0)
                for arc in arcs
            ]
            at = next(noise) * sum(weights)
            chosen = max(range(len(weights)), key=weights.__getitem__)
            for k, weight in enumerate(weights):
                at -= weight
                if at < 0 and weight > 0:
                    chosen = k
                    break
            arc = arcs[chosen]
            path.append(arc)
            entry = following.get(arc)
            node += int(self.size[arc])
        return tuple(path)


def _noise(seed: int, round_: int) -> Iterator[float]:
    step = 0
    while True:
        step += 1
        yield (xxhash.xxh3_64_intdigest(f"{seed}:{round_}:{step}".encode()) + 0.5) * 2.0**-64


def _truncated(mass, limit: float, uniform):
    """Gumbel values with these log-masses that are no larger than ``limit``."""
    with np.errstate(divide="ignore", over="ignore"):
        return mass - np.logaddexp(mass - limit, np.log(-np.log(uniform)))


@dataclass
class _Path:
    arcs: np.ndarray
    ends: np.ndarray  # arcs up to and with each word
    before: np.ndarray  # log-probability of the words before each word, and of all at the end
    value: float  # perturbed log-probability


@dataclass
class _Open:
    """Paths that agree with ``path`` before ``word`` and take none of ``taken`` there."""

    path: _Path
    word: int
    taken: list[tuple[int, ...]]


def _uniforms(seeds, places, round_: int):
    """Uniform noise of rows' places in a round, strictly between 0 and 1."""
    places = places + (np.uint64(round_) << np.uint64(40))
    return ((mixed(mixed(places) ^ seeds) >> np.uint64(11)) + 0.5) * 2.0**-53


def _uniform(seed: int, round_: int, place: int) -> float:
    return float(_uniforms(np.array([seed], np.uint64), np.array([place], np.uint64), round_)[0])


#: Below this, one minus a path's probability is summed over the other paths instead.
_CLOSE = 1e-11


def _largest(values: np.ndarray, count: int) -> list[int]:
    """Places of the largest values, in no order."""
    return range(len(values)) if len(values) <= count else np.argpartition(values, -count)[-count:].tolist()


#: Arcs of the words a task remembers.
KEPT_ARCS = 2_000_000


@dataclass
class Kept:
    """Numbers and lattice of words seen before."""

    numbers: dict[str, int]
    lattice: Lattice | None = None


def sample_texts(
    vocabulary: Vocabulary, texts: list[str], seeds: list[int], count: int, kept: Kept | None = None
) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text, up to ``count`` distinct segmentations: (ids, log-probability, inclusion score).

    The inclusion score is the probability that a path's perturbed value passes the best value that was left
    out; 1 where nothing was. A text with fewer segmentations gives them all. An empty text gives one, of no ids.
    """
    kept = kept or Kept({})
    numbers: defaultdict[str, int] = defaultdict(None, kept.numbers)
    numbers.default_factory = numbers.__len__
    split = [t.split(" ") if t else [] for t in texts]
    sizes = list(map(len, split))
    occurrences = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
    if len(occurrences) == 0:
        return [[(np.empty(0, np.int32), 0.0, 1.0)] for _ in texts]
    lattice, new = kept.lattice, list(numbers)[len(kept.numbers) :]
    if new:
        lattice = Lattice(vocabulary, new, kept.lattice)
        if len(lattice.piece) <= KEPT_ARCS:
            kept.numbers, kept.lattice = dict(numbers), lattice
    starts = np.append(0, np.cumsum(sizes))
    own_seeds = np.repeat(np.array(seeds, np.uint64), sizes)
    places = (np.arange(len(occurrences)) - np.repeat(starts[:-1], sizes)).astype(np.uint64)

    def fresh(at: np.ndarray, round_: int):
        salt = own_seeds[at] ^ mixed(places[at] + (np.uint64(round_) << np.uint64(48)))
        return lattice.draw(occurrences[at], mixed(salt))

    masses: dict[tuple, float] = {}

    def arcs_at(path: _Path, word: int) -> tuple[int, ...]:
        return tuple(path.arcs[int(path.ends[word - 1]) if word else 0 : path.ends[word]].tolist())

    def other_masses(at: np.ndarray, logp: np.ndarray, path_arcs) -> np.ndarray:
        """Probability of the words' paths other than the drawn ones."""
        left = -np.expm1(np.minimum(logp, 0.0))
        for k in np.flatnonzero(left < _CLOSE).tolist():
            key = int(occurrences[at[k]]), path_arcs(k)
            if key not in masses:
                masses[key] = lattice.others(key[0], [key[1]])
            left[k] = masses[key]
        with np.errstate(divide="ignore"):
            return np.log(left)

    def add_open(t: int, path: _Path, first: int, values: np.ndarray, round_: int) -> None:
        """The best open sets that leave the path at a word from ``first`` on."""
        for k in _largest(values, count + 1):
            if values[k] > -np.inf:
                word = first + int(k)
                heapq.heappush(queues[t], (-float(values[k]), word, round_, _Open(path, word, [arcs_at(path, word)])))

    paths: list[list[_Path]] = [[] for _ in texts]
    queues: list[list] = [[] for _ in texts]
    every = np.arange(len(occurrences))
    arcs, per_word, logp = fresh(every, 0)
    arc_ends = np.append(0, np.cumsum(per_word))
    row_seeds = np.array(seeds, np.uint64)
    values = -np.log(-np.log(_uniforms(row_seeds, np.full(len(seeds), 1 << 30, np.uint64), 0)))
    upto = np.append(0.0, np.cumsum(logp))
    open_mass = other_masses(every, logp, lambda k: tuple(arcs[arc_ends[k] : arc_ends[k + 1]].tolist()))
    open_mass += upto[:-1] - np.repeat(upto[starts[:-1]], sizes)
    open_values = _truncated(open_mass, np.repeat(values, sizes), _uniforms(own_seeds, places, 1))
    for t, (low, high) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        if low == high:
            continue
        path = _Path(
            arcs[arc_ends[low] : arc_ends[high]],
            arc_ends[low + 1 : high + 1] - arc_ends[low],
            upto[low : high + 1] - upto[low],
            float(values[t]),
        )
        paths[t].append(path)
        add_open(t, path, 0, open_values[low:high], 0)
    for round_ in range(1, count):
        popped = {t: heapq.heappop(q) for t, q in enumerate(queues) if q}
        others = {
            t: lattice.draw_other(int(occurrences[starts[t] + o[1]]), o[3].taken, _noise(seeds[t], round_))
            for t, o in popped.items()
        }
        later = {t: np.arange(starts[t] + o[3].word + 1, starts[t + 1]) for t, o in popped.items()}
        at = np.concatenate(list(later.values())) if later else np.empty(0, np.int64)
        arcs, per_word, logp = fresh(at, round_)
        arc_ends, done = np.append(0, np.cumsum(per_word)), 0
        upto = np.append(0.0, np.cumsum(logp))
        left = other_masses(at, logp, lambda k: tuple(arcs[arc_ends[k] : arc_ends[k + 1]].tolist()))
        noise = _uniforms(own_seeds[at], places[at], round_ + 1)
        for t, (negative, word, _, open_) in popped.items():
            value, size = -negative, len(later[t])
            parent, other = open_.path, others[t]
            kept = int(parent.ends[word - 1]) if word else 0
            tail = arcs[arc_ends[done] : arc_ends[done + size]]
            here = parent.before[word] + lattice.path_logp(other)
            path = _Path(
                np.concatenate([parent.arcs[:kept], np.array(other, np.int64), tail]),
                np.concatenate(
                    [parent.ends[:word], [kept + len(other)], kept + len(other) + arc_ends[done + 1 : done + size + 1] - arc_ends[done]]
                ),
                np.concatenate([parent.before[: word + 1], here + upto[done : done + size + 1] - upto[done]]),
                value,
            )
            paths[t].append(path)
            taken = [*open_.taken, other]
            rest = lattice.others(int(occurrences[starts[t] + word]), taken)
            if rest > 0:
                mass = parent.before[word] + math.log(rest)
                again = float(_truncated(mass, value, _uniform(seeds[t], round_ + 1, 1 << 31)))
                heapq.heappush(queues[t], (-again, word, 0, _Open(parent, word, taken)))
            mass = left[done : done + size] + path.before[word + 1 : -1]
            add_open(t, path, word + 1, _truncated(mass, value, noise[done : done + size]), round_)
            done += size
    out = []
    for t, mine in enumerate(paths):
        if not mine:
            out.append([(np.empty(0, np.int32), 0.0, 1.0)])
            continue
        limit = -queues[t][0][0] if queues[t] else -math.inf
        out.append(
            [
                (
                    _ids(vocabulary, lattice.piece[p.arcs]),
                    float(p.before[-1]),
                    -math.expm1(-math.exp(min(700.0, float(p.before[-1]) - limit))),
                )
                for p in mine
            ]
        )
    return out


def _ids(vocabulary: Vocabulary, pieces: np.ndarray) -> np.ndarray:
    spelt = np.flatnonzero(pieces < 0)
    if len(spelt) == 0:
        return pieces.astype(np.int32)
    parts, done = [], 0
    for at in spelt.tolist():
        raw = chr(-int(pieces[at]) - 1).encode("utf-8", "surrogatepass")
        parts += [pieces[done:at], vocabulary.byte_ids[np.frombuffer(raw, np.uint8)]]
        done = at + 1
    return np.concatenate([*parts, pieces[done:]]).astype(np.int32)


SAMPLES = "array<struct<ids:array<int>,log_prob:double,inclusion:double>>"


def _column(samples: list[list[tuple[np.ndarray, float, float]]]) -> pa.Array:
    flat = [s for row in samples for s in row]
    ids = np.concatenate([s[0] for s in flat]) if flat else np.empty(0, np.int32)
    ends = np.append(0, np.cumsum([len(s[0]) for s in flat])).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())),
            pa.array([s[1] for s in flat], pa.float64()),
            pa.array([s[2] for s in flat], pa.float64()),
        ],
        ["ids", "log_prob", "inclusion"],
    )
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in samples])).astype(np.int32)), values)


def row_seed(key: str | None, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{key}".encode())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    first = size = 0
    for row, text in enumerate(batch.column("text")):
        size += len(text.as_buffer() or b"")
        if size >= SLICE_BYTES:
            yield batch.slice(first, row + 1 - first)
            first, size = row + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def encode(
    docs: DataFrame,
    sampling: Sampling = Sampling(),
    model: str = MODEL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, samples, round_trip: ``samples`` has up to ``count`` distinct segmentations of the whole text, in
    the order of their perturbed values; ``round_trip`` says whether all of them decode to the text. Missing texts
    are empty, and give one sample without ids. Equal rows get equal samples; other columns are left aside. The
    model file is read on the driver and sent along."""
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kept = Vocabulary(shared.value, sampling.sharpness), Kept({})
        for batch in batches:
            for part in _slices(batch):
                texts = part.column("text").to_pylist()
                seeds = [row_seed(key, sampling.seed) for key in part.column("key").to_pylist()]
                samples = sample_texts(vocabulary, texts, seeds, sampling.count, kept)
                same = [
                    all(vocabulary.decode(ids) == own for ids, _, _ in row)
                    for own, row in zip((t.encode() for t in texts), samples, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), _column(samples), pa.array(same, pa.bool_())],
                    names=["doc_id", "samples", "round_trip"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches)
        give_back()  # vocabulary and lattice are gone

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(id_col).cast("string").alias("key"),
    ).mapInArrow(run, f"doc_id {id_type}, samples {SAMPLES}, round_trip boolean")


def decode(ids: Column, model: str = MODEL) -> Column:
    """The texts of arrays of piece ids (null: null)."""
    with open(model, "rb") as file:
        content = file.read()
    kept: dict = {}

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        if "v" not in kept:
            kept["v"] = Vocabulary(content, 1.0)
        out = [
            None if not row.is_valid else kept["v"].decode(row.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace")
            for row in column
        ]
        return pa.array(out, pa.string())

    return texts(ids)
