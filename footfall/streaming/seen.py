"""Event ids the stream has seen, as keyed state with a time to live.

Ids are kept in buckets by their hash, and each bucket is a key of the state store: Python and the store talk once a bucket,
not once an id. A micro-batch reads the ids of the buckets its own rows fall in. What it stored expires exactly one window
later; copies don't extend it. Copies are not dropped but leave a count, so that the sink writes rows and counts of a
micro-batch together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Executors get the processor itself, not the name of a module they may not have.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets of ids. A key costs milliseconds, a remembered id of its bucket 16 bytes; fixed for a checkpoint.
BUCKETS = 1 << 14
#: Dead letters have no id; they pass in groups of their places in the log, with numbers below zero.
_LETTER_GROUPS = 1024
_DIGEST = 16


class SeenIds(StatefulProcessor):
    """Passes the first row of each id of a bucket in log order unless the id is remembered, and one row that counts the others.

    Rows of a bucket are streamed, one is held for each new id: an id with very many copies needs no memory.
    """

    def __init__(self, ttl_ms: int):
        self.out, self.ttl_ms = Row("message", "copies"), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # What each micro-batch stored: digests one after the other. Expires as a whole.
        self.stored = handle.getListState("stored", "digests binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] < 0:
            for row in rows:
                yield self.out(row["message"], 0)
            return
        remembered = set()
        for (digests,) in self.stored.get():
            packed = bytes(digests)
            remembered.update(packed[i : i + _DIGEST] for i in range(0, len(packed), _DIGEST))
        firsts, copies = {}, 0
        for row in rows:
            digest = bytes(row["digest"])
            if digest in remembered:
                copies += 1
                continue
            here = (row["kafka_partition"], row["kafka_offset"])
            held = firsts.get(digest)
            copies += held is not None
            if held is None or here <= held[0]:
                firsts[digest] = (here, row["message"])
        if firsts:
            self.stored.appendValue((b"".join(firsts),))
        for _, first in firsts.values():
            yield self.out(first, 0)
        if copies:
            yield self.out(None, copies)

    def close(self) -> None:
        pass


def flag_copies(parsed: DataFrame, window_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """The parsed messages without copies, and rows of nulls whose ``copies`` says how many of a bucket were left out.

    An id is remembered for ``window_ms`` of processing time from the micro-batch that stored it. Needs the RocksDB state store.
    """
    identity = F.concat_ws("/", "project_id", "event_id")
    group = -1 - F.pmod(F.xxhash64("kafka_partition", "kafka_offset"), F.lit(_LETTER_GROUPS))
    bucket = F.when(F.col("reason").isNull(), F.pmod(F.xxhash64(identity), F.lit(buckets))).otherwise(group)
    # 128 bits tell ids apart.
    digest = F.when(F.col("reason").isNull(), F.unhex(F.md5(identity)))
    times = [f.name for f in parsed.schema if isinstance(f.dataType, T.TimestampType)]
    # Python gets what it decides by, and the rest as one text. Times are numbers in it: no time zone and no rounding is involved.
    plain = parsed.withColumns({name: F.unix_micros(name) for name in times})
    rows = plain.select(
        bucket.alias("bucket"),
        digest.alias("digest"),
        "kafka_partition",
        "kafka_offset",
        F.to_json(F.struct(*parsed.columns)).alias("message"),
    )
    flagged = rows.groupBy("bucket").transformWithState(
        SeenIds(window_ms), outputStructType="message string, copies bigint", outputMode="Append", timeMode="ProcessingTime"
    )
    opened = flagged.select(F.inline(F.array(F.from_json("message", plain.schema))), "copies")
    return opened.withColumns({name: F.timestamp_micros(name) for name in times})
