from __future__ import annotations

import random
from pathlib import Path

from rows import PROJECT, at

from footfall.operators.identity import first_links, merge_links
from footfall.schemas import IDENTITY_LINKS
from footfall.sources import links


def write_part(spark, path, batch_id, rows):
    spark.createDataFrame(rows, IDENTITY_LINKS).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def files(path):
    return sum(1 for root in (path, f"{path}-merged") for _ in Path(root).rglob("*.parquet"))


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*IDENTITY_LINKS.fieldNames()).collect())


def random_links(rng, count):
    return [(PROJECT, f"device-{rng.randrange(40)}", f"reader-{rng.randrange(9)}", at(rng.randrange(60))) for _ in range(count)]


def test_merged_buckets_hold_what_the_parts_held(spark, tmp_path):
    rng, path, every, kept = random.Random(1), str(tmp_path / "links"), 8, []
    most = 0
    for batch in range(40):
        rows = random_links(rng, 6)
        kept += rows
        write_part(spark, path, batch, rows)
        if (batch + 1) % every == 0:
            links.compact_links(spark, path, batch, buckets=4)
        most = max(most, files(path))
    whole = merge_links(spark.createDataFrame(kept, IDENTITY_LINKS))
    assert rows_of(links.read_links(spark, path)) == rows_of(whole)
    # Two generations of four buckets, and the parts of two intervals, however many micro-batches there were.
    assert most <= 2 * 4 + 2 * every + 4
    plan = links.read_links(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # read as it is
    first = first_links(links.read_links(spark, path)).collect()
    assert len(first) == len({r[1] for r in kept})


def test_a_reader_from_before_a_merge_still_finds_its_files(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "links")
    for batch in range(4):
        write_part(spark, path, batch, random_links(rng, 10))
    links.compact_links(spark, path, 1, buckets=2)
    before = links.read_links(spark, path)
    wanted = rows_of(before)
    links.compact_links(spark, path, 3, buckets=2)
    assert rows_of(before) == wanted == rows_of(links.read_links(spark, path))


def test_parts_that_are_not_committed_stay_parts(spark, tmp_path):
    path = str(tmp_path / "links")
    write_part(spark, path, 0, [(PROJECT, "a", "u", at(1))])
    write_part(spark, path, 1, [(PROJECT, "a", "u", at(0))])
    made = links.compact_links(spark, path, 0)
    assert (made.number, made.through, len(made.buckets)) == (1, 0, 1)
    assert rows_of(links.read_links(spark, path)) == [(PROJECT, "a", "u", at(0).replace(tzinfo=None))]
    write_part(spark, path, 0, [(PROJECT, "a", "u", at(1))])  # a replay of what is merged
    assert links.read_links(spark, path).count() == 1
    assert links.compact_links(spark, path, 0) == made


def test_two_merges_at_once_publish_one(spark, tmp_path):
    path = str(tmp_path / "links")
    write_part(spark, path, 0, [(PROJECT, "a", "u", at(1))])
    made = links.compact_links(spark, path, 0)
    assert not links._publish(spark, path, links.Manifest(made.number, 7, {}))
    assert links.latest(spark, path) == made


def test_no_links(spark, tmp_path):
    path = str(tmp_path / "links")
    assert links.read_links(spark, path).count() == 0
    assert links.compact_links(spark, path, 9) == links.Manifest()
