"""The registered queries of the text operators, with their SQL where SQL can express them.

Each applies its operator to the whole table and derives the digest columns of its contract from the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    chat,
    decontaminate,
    lang_id,
    license_scan,
    lm_score,
    near_dedup,
    pii,
    quality,
    repair,
    resample,
    secret_scan,
    segment,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: ASCII lower case, and words between the six white-space characters, in DuckDB.
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_BLANK = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"
SQL_ALNUM = "regexp_extract_all(coalesce({}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def sql_crc(strings: str) -> str:
    """CTEs that give ``crcs(s, crc)``: CRC-32 of the UTF-8 bytes of the distinct strings of a query.

    CRC-32 is linear: ``reg(m, v)`` is the register 1 after m zero bits, and each set bit of a byte adds one of its values.
    """
    return f"""
strings AS (SELECT DISTINCT s, strlen(s) AS size FROM ({strings}) AS given(s)),
reg(m, v) AS (
    SELECT -31, CAST(2147483648 AS BIGINT)
    UNION ALL
    SELECT m + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
    FROM reg WHERE m < 8 * (SELECT coalesce(max(size), 0) FROM strings)
),
byte AS (
    SELECT CAST((m + k) // 8 - 1 AS BIGINT) AS after, b, bit_xor(v) AS v
    FROM reg, range(0, 8) AS r(k), range(0, 256) AS q(b)
    WHERE (m + k) % 8 = 0 AND m + k >= 8 AND (b >> k) & 1 = 1 GROUP BY ALL
),
start AS (SELECT CAST((m + j) // 8 AS BIGINT) AS size, bit_xor(v) AS v FROM reg, range(0, 32) AS r(j) WHERE (m + j) % 8 = 0 AND m + j >= 0 GROUP BY ALL),
bytes AS (
    SELECT s, size - 1 - i AS after, CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS b
    FROM (SELECT s, size, unnest(range(0, size)) AS i FROM strings)
),
body AS (SELECT s, bit_xor(v) AS v FROM bytes JOIN byte USING (after, b) GROUP BY s),
crcs AS (
    SELECT s, xor(xor(coalesce(body.v, 0), start.v), 4294967295) AS crc
    FROM strings JOIN start USING (size) LEFT JOIN body USING (s)
)"""


@register("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, both = F.col("places"), F.concat("places", "notices")
    starts = F.transform(places, lambda m: m["start"])
    return license_scan.scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_scan.label_list(places).alias("base_labels"),
        license_scan.label_list(both).alias("labels"),
        F.coalesce(F.array_max(F.transform(both, lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


OP2 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS size FROM pages
),
last AS (SELECT h, max(page_id) AS response_id FROM p GROUP BY h)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS INTEGER) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '')
           AS payload_digest,
       CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response_id THEN response_id END AS refers_to, true AS intact
FROM p JOIN last USING (h)"""


@register("op2_warc", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


@register("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


OP4 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {SQL_BLANK.format(SQL_LOWER.format("text"))} AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words
),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
both_ways AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM both_ways
    JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b
    WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)
),
reach AS (
    SELECT doc_id AS root, doc_id AS node FROM documents
    UNION SELECT root, b FROM reach JOIN links ON a = node
),
least AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)"""


@register("op4_near_dedup", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), near_dedup.NearDup(shingle=4))


@register("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


OP6 = f"""
WITH body AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {SQL_BLANK.format("text")} AS w FROM documents
),
grams AS (
    SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, array_to_string(w[i:i + 4], ' ') AS g FROM body WHERE len(w) > 5
),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (
    SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
),
cut AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM body),
lines AS (
    SELECT doc_id, line,
           translate(regexp_extract(line, '^[\\x20\\x09-\\x0D]*(.*?)[\\x20\\x09-\\x0D]*$', 1, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS normal,
           len({SQL_BLANK.format("line")}) AS words
    FROM cut WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
held AS (
    SELECT host, normal, max(words) AS words, count(DISTINCT t) AS n FROM lines JOIN body USING (doc_id) GROUP BY host, normal
),
boiler AS (
    SELECT host, normal FROM held WHERE n >= CASE WHEN words >= 20 THEN 20 WHEN words >= 5 THEN 50 ELSE 1000 END
),
gone AS (
    SELECT doc_id, sum(words) AS n FROM lines JOIN body USING (doc_id) JOIN boiler USING (host, normal) GROUP BY doc_id
),
counts AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
    FROM body LEFT JOIN dups USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND (n_removed_words = 0
            OR (n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.3 * n_words)) AS kept
FROM counts"""


@register("op6_quality_lines", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(read(spark, sf_dir, "documents"))
    return found.drop("host", "text_hash", "removed_lines")


OP7 = f"""
WITH d AS (SELECT doc_id, {SQL_ALNUM.format(SQL_LOWER.format("text"))} AS w FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, {SQL_ALNUM.format(SQL_LOWER.format("text"))} AS w FROM benchmark
),
wanted AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
    FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS r(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM wanted),
grams AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
),
found AS (SELECT doc_id, item_id, i, grams.size FROM grams JOIN wanted USING (size, g)),
hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
),
held AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)"""


@register("op7_decontaminate", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", decontaminate.items_digest(F.col("spans"))).drop("text_hash", "spans")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@register("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*secret_scan.BASE))
    return secret_scan.detect(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count_kind(spans, kind).alias(f"n_{kind}") for kind in secret_scan.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


@register("op9_segment")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, and whether they give the text back."""
    found = segment.encode(read(spark, sf_dir, "documents"))
    first = F.col("samples")[0]
    return found.select(
        "doc_id",
        F.size("samples").alias("n_samples"),
        F.size(first["ids"]).cast("long").alias("n_pieces"),
        first["log_prob"].alias("log_prob"),
        F.transform("samples", lambda s: s["inclusion"]).alias("inclusion"),
        F.transform("samples", lambda s: F.xxhash64(s["ids"])).alias("ids_hash"),
        "round_trip",
    )


@register("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return pii.detect(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count_kind(spans, kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


OP11 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, {SQL_ALNUM.format(SQL_LOWER.format("text"))} AS w FROM documents
),
t AS (SELECT {SQL_ALNUM.format(SQL_LOWER.format("text"))} AS w FROM benchmark),
found AS (
    SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, range(1, 4) AS r(k) WHERE len(w) >= k)
),
wanted AS (
    SELECT array_to_string(w[i:i + k - 1], ' ') AS s
    FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, range(1, 4) AS r(k) WHERE len(w) >= k)
),{sql_crc("SELECT s FROM found UNION ALL SELECT s FROM wanted")},
source AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM found JOIN crcs USING (s) GROUP BY ALL),
target AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM wanted JOIN crcs USING (s) GROUP BY ALL),
gains AS (
    SELECT k AS bucket, CAST(floor(1000 * ln(
        CAST(coalesce(target.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM found) + 10000)
        / (CAST(coalesce(source.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM wanted) + 10000)))) AS BIGINT) AS gain
    FROM range(0, 10000) AS r(k) LEFT JOIN source ON source.bucket = k LEFT JOIN target ON target.bucket = k
),
weighed AS (
    SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
    FROM found JOIN crcs USING (s) JOIN gains ON bucket = crc % 10000 GROUP BY doc_id
),
scored AS (
    SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
               (CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT)
               AS score
    FROM d LEFT JOIN weighed USING (doc_id)
),
ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS size
    FROM scored WHERE words >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= 5 * size // 100 THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""


@register("op11_resample", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


OP12 = f"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s
    FROM conversations
),{sql_crc("SELECT s FROM given")},
damaged AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
           CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
    FROM (SELECT given.*, crc % 20 AS h FROM given JOIN crcs USING (s)) WHERE h <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
),
looked AS (
    SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
           left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
),
faulty AS (
    SELECT *, is_blank OR again AS must_go, CAST(cut AND NOT is_blank AND NOT again AS INTEGER) AS extra FROM looked
),
moves(letter) AS (VALUES ('D'), ('K'), ('R')),
dp AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, q, cost, audit, lines
    FROM (SELECT DISTINCT conv_id FROM faulty),
         (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (2, 2, 'I', ['user:']), (3, 4, 'II', ['user:', 'assistant:']))
         AS v(q, cost, audit, lines)
    UNION ALL
    SELECT conv_id, i, q, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS turn_of FROM (
            SELECT conv_id, i, CASE extra_turns WHEN 0 THEN q WHEN 1 THEN CASE q WHEN 2 THEN 3 ELSE 2 END
                               ELSE CASE q WHEN 2 THEN 2 ELSE 3 END END AS q,
                   cost + 2 * extra_turns AS cost, audit || repeat('I', extra_turns) AS audit,
                   lines || (CASE WHEN q = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[1:extra_turns] AS lines
            FROM (
                SELECT dp.conv_id, f.i,
                       CASE letter WHEN 'D' THEN q WHEN 'R' THEN CASE q WHEN 2 THEN 3 ELSE 2 END
                                   ELSE CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q,
                       cost + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 + extra ELSE extra END AS cost,
                       audit || letter AS audit,
                       CASE letter WHEN 'D' THEN lines
                                   WHEN 'R' THEN lines || [CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text]
                                   ELSE lines || [role || ':' || text] END AS lines
                FROM dp JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1, moves
                WHERE letter = 'D' OR NOT must_go
                      AND (letter = 'R' OR c = 's' AND q = 0 OR c = 'u' AND q IN (0, 1, 3) OR c = 'a' AND q = 2)
            ), range(0, 3) AS r(extra_turns)
        )
    ) WHERE turn_of = 1
),
faults AS (
    SELECT conv_id, max(i) AS rows_left,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (is_blank) AS blank, count(*) FILTER (again AND NOT is_blank) AS duplicate,
           sum(extra) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
),
best AS (
    SELECT dp.conv_id, cost, audit, lines FROM dp JOIN faults f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND i = rows_left
    WHERE q IN (0, 3) QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost, audit) = 1
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id"""


@register("op12_repair", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"))


@register("op13_lang_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read(spark, sf_dir, "documents"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
