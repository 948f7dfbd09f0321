"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``.

Edits are paths through a lattice: a node is (rows consumed, state of the role pattern), an arc deletes, keeps or reroles the
next row or inserts an empty turn. An auction finds the shortest path: the path's last node compares its price with the best
arc's cost plus the price at its end; it raises its price and the path contracts, or the path extends along that arc.
When the path reaches the end, an arc is on some shortest path only if it is tight (price = cost + next price), so the
audit that sorts first is traced over tight arcs, letter by letter.

A conversation is cut into segments of at most 2 ** SEGMENT_BITS rows. Where it has several, each one's shortest
costs between its states are found on their own, a pass over the segments from the last to the first adds them up, and
each segment is then solved with the costs beyond it as prices. So the search spreads over tasks whatever share of all
rows a conversation has; what stays sequential is one pass of bounded memory that hashes its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.scratch import Scratch
from footfall.llm.texts import SPACES, join_counted

SEGMENT_BITS = 5
#: States: nothing yet, after a system turn, after a user turn (an assistant must follow), after an assistant turn.
STATES = range(4)
#: Costs beyond the last row by state; None: no way to end there.
ENDS = (0, None, None, 0)
#: State after a user or assistant turn that continues the pattern, and the role of that turn, by state.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Costs.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: A row's code: class of its role's initial (0 other, 1 s, 2 u, 3 a), plus these.
MUST_GO, CUT_OFF = 4, 8
#: State after keeping a row of a class, by state.
_KEPT = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))
#: Solved segments a worker remembers.
_REMEMBERED = 50_000

Solved = tuple[tuple[int, str, int], ...]


class Lattice:
    """Arcs of a segment. ``ends``: costs from its last layer to the end of the conversation, by state.

    Turns are inserted before a row, and behind the last row of the last segment only, so that each edit list is one path.
    """

    def __init__(self, codes: Sequence[int], ends: Sequence[int | None], last: bool):
        self.codes, self.ends, self.last = codes, ends, last
        self.end = 4 * (len(codes) + 1)
        self.prices = [0] * (self.end + 1)
        self.arcs = [self._arcs(node) for node in range(self.end)]

    def _arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next node), letters in ASCII order; the way out has the empty letter."""
        row, state = divmod(node, 4)
        insert = ("I", INSERT, 4 * row + NEXT[state])
        if row == len(self.codes):
            out = [("", self.ends[state], self.end)] if self.ends[state] is not None else []
            return [*out, insert] if self.last else out
        code = self.codes[row]
        found = [("D", DELETE, node + 4), insert]
        if not code & MUST_GO:
            extra = TRUNCATED if code & CUT_OFF else 0
            kept = _KEPT[state][code & 3]
            if kept is not None:
                found.append(("K", extra, 4 * (row + 1) + kept))
            found.append(("R", REROLE + extra, 4 * (row + 1) + NEXT[state]))
        return found

    def auction(self, state: int) -> int:
        """The least cost from a state before the first row to the end, which must be reachable."""
        prices, arcs, path = self.prices, self.arcs, [state]
        while (node := path[-1]) != self.end:
            best, onward = min(((cost + prices[to], to) for _, cost, to in arcs[node]), default=(None, node))
            if best is None:  # no arc leads on: never again on a path
                prices[node] = 1 << 60
                path.pop()
            elif prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(onward)
        return prices[state]

    def trace(self, state: int) -> tuple[str, int]:
        """The first audit in ASCII order over tight arcs from a state whose auction is over; and the state it ends in."""
        dead, letters, path = set(), [], [(state, iter(self.arcs[state]))]
        while True:
            node, rest = path[-1]
            for letter, cost, to in rest:
                if to not in dead and self.prices[node] == cost + self.prices[to]:
                    if to == self.end:
                        return "".join(letters), node % 4
                    letters.append(letter)
                    path.append((to, iter(self.arcs[to])))
                    break
            else:
                dead.add(node)
                path.pop()
                letters.pop()


def solve(codes: Sequence[int], ends: Sequence[int | None] = ENDS, last: bool = True, states: Sequence[int] = (0,)) -> Solved:
    """(cost to the end of the conversation, audit, state after the segment) for each start state.

    Prices stay from one start state to the next: they remain valid, and later auctions are short.
    """
    lattice = Lattice(codes, ends, last)
    costs = [lattice.auction(state) for state in states]
    return tuple((cost, *lattice.trace(state)) for cost, state in zip(costs, states, strict=True))


def between(codes: Sequence[int]) -> list[int | None]:
    """Least costs over a segment that isn't the last, from each state to each, in one list; None: no way."""
    start_kept = any(code & 3 == 1 and not code & MUST_GO for code in codes)
    out: list[int | None] = [None] * 16
    for to in STATES:
        lattice = Lattice(codes, [0 if state == to else None for state in STATES], False)
        for state in STATES:
            if to >= 2 or state == to or (state == 0 and to == 1 and start_kept):
                out[4 * state + to] = lattice.auction(state)
    return out


def damage(conversations: DataFrame, parts: int = 20) -> DataFrame:
    """The rows (conv_id, turn, role, text, copy) after damage by ``crc32(conv_id:turn) % parts``; nulls are one space."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.col("kind"), F.col("text")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(text.cast("string"), blank).alias("text"),
        (F.crc32(name) % parts).alias("kind"),
    ).where("kind != 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))).alias("copy"),
    )


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``place``, their number in the order of conversation and turn, and their faults."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    keyed = rows.withColumns({
        "key": F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
        "digest": F.sha2(text, 256),
    })
    order = ["key", "turn", "role", "digest", "copy"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.save(
        ordered.select(
            "key",
            "conv_id",
            "turn",
            "role",
            "text",
            F.monotonically_increasing_id().alias("place"),
            F.sha2(F.concat_ws("/", F.length("key"), "key", F.length("role"), "role", "digest"), 256).alias("same"),
            (F.btrim(text, F.lit(SPACES)) == "").alias("blank"),
            (~F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1)).isin(".", "!", "?")).alias("cut_off"),
            F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("class"),
        ),
        "rows",
    )


def _segments(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, seg, codes, counts of faults, single): at most 2 ** SEGMENT_BITS rows each, in order."""
    narrow = placed.select("key", "place", "same", "blank", "cut_off", "class")
    # Only texts that occur again meet their first place; very common ones are broadcast, not shuffled.
    again = narrow.where("NOT blank").groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    again = scratch.save(again.where("copies > 1"), "again")
    marked = join_counted(narrow, again, "same", "copies", "left")
    repeat = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    late = F.col("cut_off") & ~F.col("blank") & ~repeat
    code = F.col("class") + F.when(F.col("blank") | repeat, MUST_GO).otherwise(0) + F.when(late, CUT_OFF).otherwise(0)
    rows = marked.select(
        "key",
        F.shiftright("place", SEGMENT_BITS).alias("seg"),
        F.struct("place", code.cast("int").alias("code")).alias("at"),
        F.col("blank").cast("long").alias("blank"),
        repeat.cast("long").alias("repeat"),
        late.cast("long").alias("late"),
    )
    segments = rows.groupBy("key", "seg").agg(
        F.transform(F.array_sort(F.collect_list("at")), lambda a: a["code"]).alias("codes"),  # 2 ** SEGMENT_BITS at most
        *(F.sum(c).alias(c) for c in ("blank", "repeat", "late")),
    )
    segments = scratch.save(segments, "segments")
    several = segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(False).alias("single"))
    return scratch.save(segments.join(several, "key", "left").withColumn("single", F.coalesce("single", F.lit(True))), "marked")


_COSTS = "array<int>"


def _beyond(segments: DataFrame) -> DataFrame:
    """(key, seg, ends, last) of conversations with several segments: costs from a segment's end to the conversation's."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(_REMEMBERED)(between)
        for batch in batches:
            costs = [known(tuple(codes)) for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("seg"), pa.array(costs, pa.list_(pa.int32()))], names=["key", "seg", "costs"]
            )

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, ENDS
        for batch in batches:
            found, lasts = [], []
            for now, costs in zip(batch.column("key").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                lasts.append(now != key)
                if now != key:
                    # In the last segment turns may also be inserted behind the last row, so its exits cost more than nothing.
                    key, ends, inner = now, ENDS, _with_inserts(ENDS)
                else:
                    inner = ends
                found.append(list(ends))
                ends = [
                    min((c + e for c, e in zip(costs[4 * s : 4 * s + 4], inner, strict=True) if None not in (c, e)), default=None)
                    for s in STATES
                ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("seg"), pa.array(found, pa.list_(pa.int32())), pa.array(lasts, pa.bool_())],
                names=["key", "seg", "ends", "last"],
            )

    several = segments.where("NOT single").select("key", "seg", "codes")
    costs = several.mapInArrow(matrices, f"key string, seg long, costs {_COSTS}")
    ordered = costs.repartition("key").sortWithinPartitions("key", F.desc("seg"))
    return ordered.mapInArrow(backwards, f"key string, seg long, ends {_COSTS}, last boolean")


def _with_inserts(ends: Sequence[int | None]) -> list[int]:
    """Costs of ending in each state where turns may still be inserted: one assistant, or a user and an assistant."""
    return [0 if ends[0] == 0 and s == 0 else 0 if s == 3 else INSERT if s == 2 else 2 * INSERT for s in STATES]


_SOLVED = (
    "key string, seg long, costs array<long>, audits array<string>, stops array<int>, blank long, repeat long, late long,"
    " illegal long, first int, final int"
)


def _illegal(one: int, two: int) -> bool:
    return (one, two) not in ((1, 2), (2, 3), (3, 2))


def _solved(segments: DataFrame, beyond: DataFrame) -> DataFrame:
    """Each segment's cost, audit and last state by the state it starts in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(_REMEMBERED)(solve)
        for batch in batches:
            out = {name: [] for name in ("costs", "audits", "stops", "illegal", "first", "final")}
            columns = (batch.column(c).to_pylist() for c in ("codes", "single", "ends", "last"))
            for codes, single, ends, last in zip(*columns, strict=True):
                found = known(tuple(codes)) if single else known(tuple(codes), tuple(ends), last, tuple(STATES))
                for name, values in zip(("costs", "audits", "stops"), zip(*found, strict=True), strict=True):
                    out[name].append(list(values))
                classes = [code & 3 for code in codes]
                out["illegal"].append(sum(map(_illegal, classes, classes[1:])))
                out["first"].append(classes[0])
                out["final"].append(classes[-1])
            kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int32())
            made = dict(zip(out, map(pa.array, out.values(), kinds), strict=True))
            names = [field.split(" ")[0] for field in _SOLVED.split(", ")]
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    named = beyond.select(F.col("key").alias("_key"), F.col("seg").alias("_seg"), "ends", "last")
    single = segments.where("single").withColumns({"ends": F.lit(None).cast(_COSTS), "last": F.lit(True)})
    several = segments.where("NOT single").join(named, (F.col("key") == F.col("_key")) & (F.col("seg") == F.col("_seg")))
    return single.unionByName(several.drop("_key", "_seg")).mapInArrow(run, _SOLVED)


def _steps(audit: str) -> tuple[list[str], str]:
    """The letters that end with each row's own, and those behind the last row."""
    steps, start = [], 0
    for k, letter in enumerate(audit):
        if letter != "I":
            steps.append(audit[start : k + 1])
            start = k + 1
    return steps, audit[start:]


class _Walk:
    """Follows one conversation's audit over its rows; holds one segment's audit and no texts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost = conv_id, 0, None
        self.counts = [0, 0, 0, 0]  # blank, repeat, late, illegal
        self.before = None

    def enter(self, segment: dict) -> str:
        """Takes up a segment; returns its audit."""
        at = self.state if len(segment["audits"]) > 1 else 0
        if self.cost is None:
            self.cost = segment["costs"][at]
        self.after = segment["stops"][at]
        self.steps, self.tail = _steps(segment["audits"][at])
        self.steps.reverse()
        for k, name in enumerate(("blank", "repeat", "late", "illegal")):
            self.counts[k] += segment[name]
        if self.before is not None:
            self.counts[3] += _illegal(self.before, segment["first"])
        self.before = segment["final"]
        return segment["audits"][at]

    def turns(self, role: str, text: str) -> list[tuple[str, str, str]]:
        """(edit, role, text) of the repaired turns up to and with this row."""
        step = self.steps.pop()
        found = []
        for letter in step + (self.tail if not self.steps else ""):
            if letter == "I":
                found.append((letter, ROLE[self.state], ""))
                self.state = NEXT[self.state]
            elif letter == "R":
                found.append((letter, ROLE[self.state], text))
                self.state = NEXT[self.state]
            elif letter == "K":
                found.append((letter, role, text))
                self.state = _KEPT[self.state][{"s": 1, "u": 2, "a": 3}[role[0]]]
        return found


def _walked(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's segments, each followed by its rows, in order and in one partition."""
    heads = solved.withColumns({
        "conv_id": F.lit(None).cast("long"),
        "turn": F.lit(None).cast("long"),
        "role": F.lit(None).cast("string"),
        "text": F.lit(None).cast("string"),
        "place": F.lit(-1).cast("long"),
    })
    rows = placed.select("key", "conv_id", "turn", "role", "text", "place", F.shiftright("place", SEGMENT_BITS).alias("seg"))
    order = ["key", "seg", "place"]
    return heads.unionByName(rows, allowMissingColumns=True).repartition("key").sortWithinPartitions(*order)


_SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string"
)
_TURNS = "conv_id long, position long, role string, text string, edit string"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [field.strip().split(" ") for field in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows as dicts, a few at a time, so that long texts are not all objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield batch.slice(start, 256).to_pylist()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = key = None
    made: list[tuple] = []

    def ended() -> tuple:
        gaps = 0 if low is None else high - low + 1 - distinct
        return (walk.conv_id, gaps, *walk.counts, walk.cost, "".join(audit), digest.hexdigest())

    for rows in _each_row(batches):
        for row in rows:
            if row["key"] != key:
                if walk is not None:
                    made.append(ended())
                key, walk, audit, digest = row["key"], _Walk(int(row["key"]) if row["key"] else None), [], hashlib.sha256()
                low = high = None
                distinct, some = 0, False
            if row["place"] < 0:
                audit.append(walk.enter(row))
                continue
            if row["turn"] is not None and row["turn"] != high:  # turns come in order
                low, high, distinct = row["turn"] if low is None else low, row["turn"], distinct + 1
            for _, role, text in walk.turns(row["role"], row["text"]):
                digest.update((("\n" if some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                some = True
        if made:
            yield _table(made, _SUMMARY)
            made = []
    if walk is not None:
        yield _table([ended()], _SUMMARY)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = key = None
    position = 0
    for rows in _each_row(batches):
        made = []
        for row in rows:
            if row["key"] != key:
                key, walk, position = row["key"], _Walk(int(row["key"]) if row["key"] else None), 0
            if row["place"] < 0:
                walk.enter(row)
                continue
            for edit, role, text in walk.turns(row["role"], row["text"]):
                made.append((walk.conv_id, position, role, text, edit))
                position += 1
        yield _table(made, _TURNS)


def _run(rows: DataFrame, body: Callable, schema: str) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "repair")
    placed = _placed(rows, scratch)
    segments = _segments(placed, scratch)
    solved = scratch.save(_solved(segments, scratch.save(_beyond(segments), "beyond")), "solved")
    return _walked(placed, solved).mapInArrow(body, schema)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (0, 1, ...), role, text and the edit (K, R or I) that made the turn.

    ``rows`` holds conv_id, turn, role, text, such as ``damage`` gives, and a column copy that tells repeated rows apart; a
    null role or text must be a space by then. Turns are ordered by turn (nulls first), then role, text and copy. Rows without
    a conv_id are one conversation. A conversation whose rows are all deleted has no turns.
    """
    return _run(rows, _repaired, _TURNS)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``: faults, gaps in the turns, least cost, audit and hash of the repair."""
    return _run(rows, _summaries, _SUMMARY)


def repair(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them: one row for each conv_id (a null one too), also where no row is left.

    Nulls in role and text are one space, so blank. Rows that repeat a turn stay in the order of role and text. Empty
    and very long texts are rows like others. Other columns are left aside. Without rows the result is empty.
    """
    found = audits(damage(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = found.withColumnRenamed("conv_id", "_found")
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")

    def filled(name: str) -> Column:
        empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
        return F.coalesce(name, F.lit(empty.get(name, 0))).alias(name)

    return joined.select("conv_id", *(filled(c) for c in found.columns if c != "_found"))
