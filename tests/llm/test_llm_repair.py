from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from footfall.llm import repair
from footfall.llm.repair import CUT_OFF, ENDS, MUST_GO, STATES

SPACES = " \t\n\x0b\x0c\r"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
TURN = {0: "user", 1: "user", 3: "user", 2: "assistant"}


def least(rows):
    """(cost, audit, lines) by a table over rows (role, text, must_go, cut_off): the least of all edit lists."""

    def with_inserts(best):
        for _ in range(5):
            for q, (cost, audit, lines) in list(best.items()):
                to = STEP[q, TURN[q][0]]
                best[to] = min(best.get(to, (cost + 3, "")), (cost + 2, audit + "I", (*lines, f"{TURN[q]}:")))
        return best

    best = with_inserts({0: (0, "", ())})
    for role, text, must_go, cut_off in rows:
        after = {}

        def put(q, found, after=after):
            after[q] = min(after.get(q, found), found)

        for q, (cost, audit, lines) in best.items():
            put(q, (cost + 3, audit + "D", lines))
            if not must_go:
                if (q, role[:1]) in STEP:
                    put(STEP[q, role[:1]], (cost + cut_off, audit + "K", (*lines, f"{role}:{text}")))
                put(STEP[q, TURN[q][0]], (cost + 2 + cut_off, audit + "R", (*lines, f"{TURN[q]}:{text}")))
        best = with_inserts(after)
    return min(best[q] for q in (0, 3) if q in best)


def damaged(rows):
    """Rows (conv_id, turn, role, text) after damage, by conversation, in order."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({33: None, 46: None, 63: None}) if kind == 2 else text
        role = "user" if kind == 4 else role
        found[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return found


def brute_force(rows):
    out = []
    for conv, left in damaged(rows).items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in left:
            blank = not text.strip(SPACES)
            again = not blank and (role, text) in seen
            cut = not blank and not again and text.strip(SPACES)[-1] not in ".!?"
            seen.add((role, text))
            counts = [c + int(x) for c, x in zip(counts, (blank, again, cut), strict=True)]
            marked.append((role, text, blank or again, int(cut)))
        firsts = [role[:1] for _, role, _ in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = least(marked)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, key string, seg string, place string, kind string, copy string, same string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "s", "p", "x", "c", "d") for r in rows], SCHEMA)


def random_rows(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Unknown", "admin", "sage"])
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(["Yes.", "No", "Why?  ", " ", "", "Go!\n", "So it is."])))
    return rows


CODES = [0, 1, 2, 3, 2, 3, MUST_GO, 2 + MUST_GO, 2 + CUT_OFF, 3 + CUT_OFF, 1 + CUT_OFF, CUT_OFF]
ROLES = {0: "x", 1: "s", 2: "u", 3: "a"}


def as_rows(codes):
    return [(ROLES[c & 3], "t", bool(c & MUST_GO), int(bool(c & CUT_OFF))) for c in codes]


def test_auctions_find_the_least_cost_and_the_first_audit():
    rng = random.Random(3)
    for _ in range(3000):
        codes = [rng.choice(CODES) for _ in range(rng.randrange(0, 9))]
        ((cost, audit, _),) = repair.solve(codes)
        assert (cost, audit) == least(as_rows(codes))[:2]


def test_prices_bound_every_arc_and_are_tight_on_the_path():
    rng = random.Random(4)
    for _ in range(200):
        codes = [rng.choice(CODES) for _ in range(rng.randrange(1, 12))]
        lattice = repair.Lattice(codes, ENDS, True)
        lattice.auction(0)
        assert all(lattice.prices[i] <= cost + lattice.prices[to] for i, arcs in enumerate(lattice.arcs) for _, cost, to in arcs)


def test_segments_give_the_whole_lattice():
    rng = random.Random(5)
    for _ in range(800):
        codes = [rng.choice(CODES) for _ in range(rng.randrange(2, 14))]
        cuts = [0, *sorted(rng.sample(range(1, len(codes)), rng.randrange(1, min(4, len(codes))))), len(codes)]
        parts = [codes[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        ends, inner = [list(ENDS)], repair._with_inserts(ENDS)
        for part in reversed(parts[1:]):
            costs = repair.between(part)
            inner = [
                min((c + e for c, e in zip(costs[4 * s : 4 * s + 4], inner, strict=True) if None not in (c, e)), default=None)
                for s in STATES
            ]
            ends.insert(0, inner)
        state, total, audit = 0, None, ""
        for k, part in enumerate(parts):
            cost, piece, after = repair.solve(part, ends[k], k == len(parts) - 1, tuple(STATES))[state]
            total, audit, state = cost if total is None else total, audit + piece, after
        assert (total, audit) == least(as_rows(codes))[:2]


def test_random_conversations_equal_the_brute_force(spark):
    rows = random_rows(random.Random(6), 150, 10)
    assert rows_of(repair.repair(table(spark, rows))) == brute_force(rows)


@pytest.mark.parametrize("bits", [1, 5])
def test_a_conversation_spread_over_segments_and_tasks(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rng = random.Random(7)
    rows = random_rows(rng, 20, 6) + [(99, t, rng.choice(["user", "assistant"]), rng.choice(["Ja.", "Nein.", "?", f"x{t}"])) for t in range(500)]
    assert rows_of(repair.repair(table(spark, rows).repartition(6))) == brute_force(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "A."), (1, None, "user", "A."), (1, 3, None, "B."),
        (2, 1, "user", "x" * 300_000), (2, 1, "assistant", "y." * 100_000), (2, 1, "assistant", "y." * 100_000), (3, 5, "assistant", ""),
        (4, -3, "system", "é 你 ."), (4, 9, "user", "𝒳?"), (4, 9, "user", "𝒳?"), (5, 0, "", "\x00."),
    ]
    assert rows_of(repair.repair(table(spark, rows))) == brute_force(rows)
    assert repair.repair(table(spark, rows).limit(0)).count() == 0


def test_repaired_turns_are_the_hashed_ones(spark):
    rows = random_rows(random.Random(8), 60, 12)
    left = repair.damage(table(spark, rows))
    turns = repair.repaired_turns(left)
    line = F.concat_ws(":", "role", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n")
    made = {r["conv_id"]: r["h"] for r in turns.groupBy("conv_id").agg(F.sha2(joined, 256).alias("h")).collect()}
    for row in repair.audits(left).collect():
        assert made.get(row["conv_id"], hashlib.sha256().hexdigest()) == row["repaired_sha256"]
    initials = turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "role"))), lambda x: x["role"].substr(1, 1)), "").alias("s")
    )
    assert initials.where("NOT s RLIKE '^s?(ua)+$'").isEmpty()
