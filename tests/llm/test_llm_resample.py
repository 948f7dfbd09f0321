from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from math import floor, log

import pytest
from pyspark.sql import functions as F

from footfall.llm import resample
from footfall.llm.resample import Resampling


def words_of(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return "".join(c if c.isdigit() and c.isascii() or c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in low).split(" ")


def features(text):
    words = [w for w in words_of(text) if w]
    return len(words), [
        zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)
    ]


def brute_force(rows, target):
    """(id, n_features, weight, score, rank) of rows (id, text), sorted."""
    found = [(k, *features(t)) for k, t in rows]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for text in target for b in features(text)[1])
    size, wanted = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1.0) * (size + 10000.0) / ((s[b] + 1.0) * (wanted + 10000.0)))) for b in s}
    scored = []
    for k, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((k, n, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    order = sorted(
        (r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3])
    )
    ranks = {}
    for k, row in enumerate(order[: 5 * len(order) // 100]):
        ranks.setdefault(row, []).append(k + 1)
    return sorted(((*r[:1], *r[2:], ranks[r].pop(0) if ranks.get(r) else None) for r in scored), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_buckets_of_runs_of_words_are_those_of_their_bytes():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé你") for _ in range(rng.choice([1, 2, 7, 90, 300, 70_000]))) for _ in range(30)]
    text = " ".join(words).encode()
    found = sorted(b for _, part in resample.Features(Resampling()).buckets(text) for b in part.tolist())
    assert found == sorted(features(text.decode())[1])


def test_runs_reach_over_the_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr("footfall.llm.texts.PIECE", 64)
    text = " ".join(f"word{k}" for k in range(200))
    parts = list(resample.Features(Resampling()).buckets(text.encode()))
    assert len(parts) > 5 and sum(n for n, _ in parts) == 200
    assert sorted(b for _, part in parts for b in part.tolist()) == sorted(features(text)[1])


def test_edge_rows_equal_the_brute_force(spark, edge_docs, edge_rows, no_docs):
    target = ["the river and stone bread", None, "cloud seven water " * 9]
    wanted = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, rank string")
    assert rows_of(resample.resample(edge_docs, wanted)) == brute_force([r[:2] for r in edge_rows], target)
    assert rows_of(resample.resample(edge_docs, wanted.limit(0))) == brute_force([r[:2] for r in edge_rows], [])
    assert resample.resample(no_docs, wanted).count() == 0


def test_many_ties_and_far_ids_equal_the_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(rng.choice([1, -1]) * rng.randrange(1 << 62) * 2, " ".join(rng.choices(vocabulary, k=25))) for _ in range(300)]
    rows += [(k % 7, "same words " * 15) for k in range(200)]  # ids and texts that repeat
    target = [" ".join(rng.choices(vocabulary[:50], k=40)) for _ in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows_of(resample.resample(docs, wanted)) == brute_force(rows, target)


def test_drawn_documents_lean_towards_the_target(spark):
    rng = random.Random(4)
    plain, wanted = [f"a{k}" for k in range(200)], [f"b{k}" for k in range(200)]
    rows = [(k, " ".join(rng.choices(wanted if k % 10 == 0 else plain, k=40)), k) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank long")
    target = spark.createDataFrame([(" ".join(rng.choices(wanted, k=400)),)], "text string")
    found = resample.drawn(docs, target).collect()
    assert len(found) == 20 and all(r["doc_id"] % 10 == 0 and r["rank"] == r["doc_id"] for r in found)


@pytest.mark.parametrize("hot", [False, True])
def test_radix_places_are_a_stable_sort(spark, monkeypatch, hot):
    monkeypatch.setattr(resample, "BLOCK_BITS", 5)
    monkeypatch.setattr(resample, "DIGIT_BITS", 3)
    key = F.when(F.col("id") % 3 > 0, 7) if hot else None
    a = F.pmod(F.xxhash64("id"), F.lit(100))
    rows = spark.range(700, numPartitions=6).select("id", (F.coalesce(key, a) if hot else a).alias("a"), (F.col("id") % 11).alias("b"))
    found = [(r["a"], r["b"]) for r in resample.radix_places(rows, ["a", "b"]).orderBy("place").collect()]
    assert found == sorted(found)
    places = [r["place"] for r in resample.radix_places(rows, ["b"]).select("place").collect()]
    assert sorted(places) == list(range(700))
    assert resample.radix_places(rows.limit(0), ["a"]).count() == 0
