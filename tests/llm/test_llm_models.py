"""Web archives, language-model scores, chat parsing, sampled segmentations, and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import chat, lm_score, segment, warc

# --- Web archives --------------------------------------------------------------------------------------------


def page_rows():
    rng = random.Random(2)
    bodies = ["<p>one</p>", "<p>two</p>", "", None, "é" * 50, "x" * 300_000]
    rows = [(k, f"http://h{k % 7}.example.org:80/a/{k % 5}?q={k}#f", rng.choice(bodies)) for k in range(120)]
    rows += [(200, None, "lonely"), (201, "no url at all \r\n", "x y"), (202, "http://[bad", None), (None, "http://a.b/", "nil")]
    return rows + [rows[0], rows[0], (-5, "http://UPPER.Example.ORG", "neg"), (300, rows[1][1], "other")]


def expected_pages(rows, least=0):
    last = {}
    for page_id, _, body in rows:
        if page_id is not None and page_id >= last.get(body or "", -(10**9)):
            last[body or ""] = page_id
    out = Counter()
    for page_id, _, body in rows:
        raw = (body or "").encode()
        response = last.get(body or "", page_id) if len(raw) >= least else page_id
        same = response == page_id
        out[(page_id, len(raw), warc.base32_sha1(raw), "response" if same else "revisit", None if same else response, True)] += 1
    return out


@pytest.mark.parametrize("least", [0, 20])
def test_every_page_comes_back_from_the_archives(spark, least):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(3)
    got = warc.archive_and_read(pages, least)
    found = Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in got.collect()
    )
    # Rows that repeat a capture (same url and page) are all found by its key.
    assert found == expected_pages(rows, least)


def test_no_pages(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_index_finds_runs_of_a_key_across_blocks_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(f"k{k // 10:03d}".encode(), k, "f", 7 * k, k + 1) for k in range(200)] + [(b"k005", k, "g", k, 1) for k in range(40)]
    captures = spark.createDataFrame(rows, "key binary, page_id long, file string, offset long, length long")
    shards = warc.build_index(captures, str(tmp_path))
    listed = sorted((bytes(r.first_key).decode(), r.file, r.offset, r.length) for r in shards.collect())
    assert len(listed) > 1
    index = warc.Index(str(tmp_path), listed)
    for key in ["k000", "k005", "k019", "a", "k0055", "z"]:
        assert Counter(index.find(key)) == Counter((r[2], r[3], r[4]) for r in rows if r[0].decode() == key)


def test_url_keys():
    assert warc.url_key("http://www.Example.org:80/a?b#c") == "org,example,www)/a?b"
    assert warc.url_key("https://x.io:8443") == "io,x:8443)/" and warc.url_key("http://[bad") == ")http://[bad"
    keys = [warc.capture_key("http://a.b/", k) for k in (-3, 0, 5, 10**18)]
    assert keys == sorted(keys) and warc.capture_key("http://a.b/", None) < keys[0]


def test_records_are_plain_warc():
    member = warc.record("response", "http://a.b/", 4, b"body\r\n\r\nmore", "D", 12)
    fields, _, http, payload = warc.parse_record(member)
    assert payload == b"body\r\n\r\nmore" and http["Content-Length"] == "12" and fields["WARC-Target-URI"] == "http://a.b/"
    fields, _, http, payload = warc.parse_record(warc.record("revisit", "u", 4, b"", "D", 12, 9))
    assert payload == b"" and http["Content-Length"] == "12" and fields["WARC-Refers-To"] == "<urn:page:9>"


# --- Language-model scores -----------------------------------------------------------------------------------

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_base(rows):
    cut = [(i, [*BLANK.findall(lower_ascii(t)), None]) for i, t in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, words in cut if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        for i, w in cut
    ]


def check_base(got, rows):
    wanted = sorted(plain_base(rows), key=repr)
    found = sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr
    )
    assert len(found) == len(wanted)
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    assert Counter(map(key, found)) == Counter(map(key, wanted))


def test_base_scores_equal_plain_counts(edge_docs, edge_rows, monkeypatch):
    check_base(lm_score.score(edge_docs).collect(), [r[:2] for r in edge_rows])


def test_rare_tokens_come_by_the_join(edge_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(lm_score, "COMMON", 50)  # few common tokens, and small memories in the tasks
    check_base(lm_score.score(edge_docs).collect(), [r[:2] for r in edge_rows])


def test_no_texts_to_learn_from(no_docs, spark):
    assert lm_score.score(no_docs).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = lm_score.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert abs(row.score + 5 * math.log10(2) * 4 + 0) < 20 and row.score < 0


def test_probabilities_of_all_next_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    size = int(lm_score._FIRST[-1])
    model = lm_score.Model(
        rng.normal(size=size).astype(np.float32), rng.integers(0, 4, size).astype(np.int8),
        rng.normal(size=(lm_score.GATES, lm_score.INPUTS + 1)) / 3, rng.normal(size=(256, lm_score.MAP_STEPS)),
    )
    start = model.cost([b"th"])[0]
    assert abs(sum(2.0 ** -(c - start) for c in model.cost([b"th" + bytes([k]) for k in range(256)])) - 1) < 1e-6


def test_learnt_language_costs_less_than_other_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(150)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(80))) for k in range(300)]
    rows += [(1000 + k, " ".join("".join(rng.choice("qxzjkvwyphg") for _ in range(5)) for _ in range(80))) for k in range(20)]
    learnt = [r for r in rows if r[0] < 1000]
    docs = spark.createDataFrame(learnt + [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 == 2 and i >= 1000], "doc_id long, text string")
    got = [r for r in lm_score.score(docs).collect() if r.held_out]
    bits = {r.doc_id: -r.score / math.log10(2) / r.n_bytes for r in got}
    own, other = [b for i, b in bits.items() if i < 1000], [b for i, b in bits.items() if i >= 1000]
    assert own and other and max(own) < min(other) and np.mean(own) < 2.6
    assert all(r.score < 0 for r in got)


def test_units_join_to_the_text():
    for text in (b"", b" ", b"a  b\nc ", b"\xff", "é ñ".encode()):
        assert b"".join(lm_score.units_of(text)) == text + b"\xff"


# --- Chat parsing --------------------------------------------------------------------------------------------


def chat_rows(conversations=40, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        turns = rng.randrange(1, 9)
        for t in range(turns):
            role = "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[(t + (c % 4 == 0)) % 2]
            size = {"system": 4, "user": 6, "assistant": 25}[role]
            lines = [" ".join(rng.choice(("Why", "sun", "moon", "Tell")) for _ in range(rng.randrange(1, size))) for _ in range(rng.randrange(1, 4))]
            rows.append((c, t, role, "\n".join(lines) + ("?" if role == "user" else ".")))
    return rows


CHAT = "conv_id long, turn long, role string, text string"


def random_model(seed):
    rng = np.random.default_rng(seed)
    logs = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    return chat.Markov(logs(1, chat.STATES)[0], logs(chat.STATES, chat.STATES), [logs(chat.STATES, c) for c in chat.CARDS])


def test_chained_segments_equal_plain_viterbi():
    rng = np.random.default_rng(7)
    for seed in range(30):
        model = random_model(seed)
        values = np.column_stack([rng.integers(0, c, 7) for c in chat.CARDS])
        emit = model.emissions(values)
        best = max(
            itertools.product(range(chat.STATES), repeat=5),
            key=lambda s: model.first[s[0]] + sum(emit[k, x] for k, x in enumerate(s)) + sum(model.move[a, b] for a, b in itertools.pairwise(s)),
        )
        cuts = [values[:2], values[2:3], values[3:5]]
        ends = chat.chain([chat.segment_matrix(model, v, k == 0) for k, v in enumerate(cuts)])
        got = np.concatenate([chat.decode(model, v, k == 0, *ends[k]) for k, v in enumerate(cuts)])
        assert tuple(got) == best


def test_segment_length_does_not_change_the_parse(spark, monkeypatch):
    turns = spark.createDataFrame(chat_rows(), CHAT).repartition(3)
    lines = chat.marked(chat.turn_lines(turns))
    model = chat.fit(lines)
    wanted = Counter(map(tuple, chat.parse(lines, model).collect()))
    monkeypatch.setattr(chat, "SEGMENT", 3)
    assert Counter(map(tuple, chat.parse(lines, model).collect())) == wanted
    assert len(wanted) == lines.count()


def test_written_transcripts_equal_a_plain_rendering(spark, tmp_path, monkeypatch):
    turns = spark.createDataFrame(chat_rows(), CHAT).repartition(3)
    lines = chat.marked(chat.turn_lines(turns))
    model = chat.fit(lines)

    def order(r):
        return r.conv_id, r.turn, r.role, r.tie, r.line

    conversations = {}
    seen = lines.withColumns({"features": chat.features(F.col("text")), "bare": chat.without_marker(F.col("text"))})
    for r in sorted(seen.collect(), key=order):
        conversations.setdefault(r.conv_id, []).append(r)
    monkeypatch.setattr(chat, "SEGMENT", 3)
    chat.write_transcripts(chat.parse(lines, model), str(tmp_path / "out"))
    written = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=order):
        written[r.conv_id] = written.get(r.conv_id, "") + r.rendered
    assert written.keys() == conversations.keys()
    for conv_id, rows in conversations.items():
        emit = [sum(model.emit[f][:, v] for f, v in enumerate(r.features)) for r in rows]
        best, ways = model.first + emit[0], [[s] for s in range(chat.STATES)]
        for e in emit[1:]:
            reach = best[:, None] + model.move
            ways = [[*ways[reach[:, s].argmax()], s] for s in range(chat.STATES)]
            best = reach.max(axis=0) + e
        states = ways[best.argmax()]
        text = ""
        for k, (r, state) in enumerate(zip(rows, states, strict=True)):
            if state < len(chat.ROLES):
                text += ("<|end|>\n" if k else "") + f"<|{chat.ROLES[state]}|>\n"
            text += (r.bare if state < len(chat.ROLES) else r.text) + "\n"
        assert written[conv_id] == text



def test_roles_are_recovered_and_turns_rendered(spark):
    turns = spark.createDataFrame(chat_rows(80), CHAT)
    rows = chat.format_chats(turns).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.n_right for r in held) / sum(r.n_lines for r in held) > 0.85
    raw = spark.createDataFrame(
        [("c", 0, "Human: Why moon\nsun?"), ("c", 1, "### AI: Tell sun moon sun moon sun moon sun."), ("c", 2, "Q: Why?")],
        "conv_id string, turn long, text string",
    )
    model = chat.fit(chat.marked(chat.turn_lines(turns)))
    parts = chat.parse(chat.turn_lines(raw), model).orderBy("turn", "line").collect()
    assert "".join(p.rendered for p in parts) == (
        "<|user|>\nWhy moon\nsun?\n<|end|>\n<|assistant|>\nTell sun moon sun moon sun moon sun.\n<|end|>\n<|user|>\nWhy?\n"
    )


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (None, 1, "robot", "x\ny"), (2, None, "user", ""), (3, 1, "USER ", "a" * 100_000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, CHAT).withColumn("place", F.lit(1))).collect()}
    assert {k: (r.n_lines, r.n_labelled) for k, r in got.items()} == {1: (2, 2), None: (3, 0), 2: (1, 1), 3: (1, 1)}
    assert chat.format_chats(spark.createDataFrame([], CHAT)).collect() == []


# --- Sampled segmentations -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(segment.MODEL, "rb") as file:
        return segment.Vocabulary(file.read(), 1.0)


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=segment.MODEL)


TEXTS = ["", "a", " Hello  world\nfoo é 你好 ▁x", "the the cat", "   ", "\n", "𝒳y \x00z", "co" * 400, "x" * 3000]


def test_samples_are_distinct_ordered_and_decode_to_the_text(vocabulary, processor):
    seeds = [segment.row_seed(str(k), 0) for k in range(len(TEXTS))]
    for text, samples in zip(TEXTS, segment.sample_texts(vocabulary, TEXTS, seeds, 5), strict=True):
        assert len({tuple(ids) for ids, _, _ in samples}) == len(samples)
        for ids, log_prob, inclusion in samples:
            assert vocabulary.decode(ids).decode() == text and processor.decode(ids.tolist()) == text
            assert log_prob <= 1e-9 and 0 <= inclusion <= 1


def all_segmentations(vocabulary, word):
    """(ids, log-probability) of every path of one word's lattice, by plain recursion."""
    lattice = segment.Lattice(vocabulary, [word])
    out = []

    def walk(node, arcs):
        if node == lattice.start[1]:
            out.append((tuple(lattice.piece[arcs].tolist()), sum(lattice.logp[a] for a in arcs)))
            return
        for arc in range(lattice.low[node], lattice.low[node + 1]):
            walk(node + lattice.size[arc], [*arcs, arc])

    walk(0, [])
    return out


def test_lattice_probabilities_are_normalised_and_follow_the_weights(vocabulary):
    paths = all_segmentations(vocabulary, "there")
    assert abs(sum(math.exp(p) for _, p in paths) - 1) < 1e-9 and len(paths) > 10
    weights = {ids: sum(vocabulary.weight[i] for i in ids) for ids, _ in paths}
    total = np.logaddexp.reduce(list(weights.values()))
    assert all(abs(p - (weights[ids] - total)) < 1e-9 for ids, p in paths)


def test_draws_follow_sampling_without_replacement():
    with open(segment.MODEL, "rb") as file:
        flat = segment.Vocabulary(file.read(), 0.3)  # flatter, so that many paths have a chance
    paths = {ids: math.exp(p) for ids, p in all_segmentations(flat, "at")}
    n = 20_000
    firsts, pairs = Counter(), Counter()
    for row in segment.sample_texts(flat, ["at"] * n, [segment.row_seed(str(k), 7) for k in range(n)], 2):
        a, b = (tuple(s[0].tolist()) for s in row)
        firsts[a] += 1
        pairs[a, b] += 1
    for ids, p in paths.items():
        assert abs(firsts[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    for (a, pa_), (b, pb) in itertools.permutations(paths.items(), 2):
        wanted = pa_ * pb / (1 - pa_)
        assert abs(pairs[a, b] / n - wanted) < 5 * math.sqrt(wanted / n) + 1e-3


def test_inclusion_scores_estimate_sums_without_bias():
    with open(segment.MODEL, "rb") as file:
        flat = segment.Vocabulary(file.read(), 0.3)
    n = 6000
    sums = []
    for row in segment.sample_texts(flat, ["the at"] * n, [segment.row_seed(str(k), 9) for k in range(n)], 3):
        sums.append(sum(math.exp(log_prob) / inclusion for _, log_prob, inclusion in row))
    assert abs(np.mean(sums) - 1) < 5 * np.std(sums) / math.sqrt(n)


def test_short_texts_give_all_their_segmentations(vocabulary):
    paths = all_segmentations(vocabulary, "on")
    samples = segment.sample_texts(vocabulary, ["on"], [3], len(paths) + 5)[0]
    assert {tuple(ids.tolist()) for ids, _, _ in samples} == {ids for ids, _ in paths}
    assert all(inclusion == 1 for _, _, inclusion in samples)


def test_samples_do_not_depend_on_batches(spark, edge_docs, edge_rows, no_docs, monkeypatch):
    def drawn(docs):
        rows = segment.encode(docs, segment.Sampling(count=3)).collect()
        return Counter(
            (r.doc_id, *((tuple(s.ids), round(s.log_prob, 6), round(s.inclusion, 6)) for s in r.samples)) for r in rows
        )

    wanted = drawn(edge_docs)
    monkeypatch.setattr(segment, "SLICE_BYTES", 50)
    assert drawn(edge_docs.repartition(4)) == wanted
    found = segment.encode(edge_docs)
    assert all(r.round_trip for r in found.collect()) and found.count() == len(edge_rows)
    texts = found.select(segment.decode(F.get("samples", F.lit(1))["ids"]).alias("text")).where("text IS NOT NULL")
    assert {r.text for r in texts.collect()} <= {r[1] or "" for r in edge_rows}
    assert segment.encode(no_docs).collect() == []


# --- The pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect_in_order(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item, base = text(30), text(100)
    rows = [(k, text(60), "en", "s", 1) for k in range(20)]
    rows += [(30, base, "en", "s", 1), (31, base, "en", "t", 1), (32, base + " tail", "en", "s", 1)]
    rows += [(40, text(20) + " " + item, "en", "s", 1), (41, text(50) + " mail me at bob@example.org now", "en", "s", 1)]
    rows += [(50, "too short", "en", "s", 1), (51, None, None, None, None), (None, text(40), "en", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.collect()})
    every = {r[0] for r in rows}
    assert every - kept[0] == {50, 51} and kept[0] - kept[1] == {31, 32} and kept[1] - kept[2] == {40}
    assert kept[3] == kept[2] and "<EMAIL>" in docs.where("doc_id = 41").first().text
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept[3] and {r["sample"] for r in out} == {0, 1}
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_on_odd_rows_and_on_none(spark, edge_docs, no_docs, edge_rows, tmp_path):
    items = spark.createDataFrame([("i1", edge_rows[5][1])] * 3 + [("i2", None), (None, "")], "item_id string, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge_docs, str(tmp_path))
        found[name] = [r.asDict() for r in out.collect()]
        assert stage(spark, no_docs, str(tmp_path)).collect() == []
        if name != "pieces":
            assert out.columns == edge_docs.columns
            assert all(r["kept"] == "x" and r["_hash"] == "x" for r in found[name])
    ids = {name: Counter(r["doc_id"] for r in rows) for name, rows in found.items()}
    before = Counter(r[0] for r in edge_rows)
    assert not {0, 1, 2, 3, 4} & set(ids["quality_rules"])
    # Ids 6, 7 and 14 are near the text of id 5, which stays with its repeated rows.
    assert ids["near_duplicates"] == Counter({k: n for k, n in before.items() if k not in (6, 7, 14)})
    # The item is the text of ids 5, 6 and 14, stands in most of 7, and in a row without id; id 5 has another text as well.
    kept = {k: n for k, n in before.items() if k not in (6, 7, 14)} | {5: 1, None: 1}
    assert ids["decontamination"] == Counter(kept)
    assert ids["personal_data"] == before
    texts = {r["doc_id"]: r["text"] for r in found["personal_data"]}
    assert texts[0] is None and texts[1] == "" and "bob@" not in texts[13] and len({r["text"] for r in found["personal_data"] if r["doc_id"] == 5}) == 2
    assert ids["pieces"].keys() == before.keys() and ids["pieces"][0] == ids["pieces"][1] == 1
    assert ids["pieces"][9] == 2 and ids["pieces"][5] == 2 * before[5]


def test_costs_of_frequent_units_are_those_of_the_model_and_computed_once(spark, monkeypatch):
    words = [f"{a}{b}" for a in ("pre", "press", "prose") for b in ("", "ed", "ing", "ings")]
    texts = [" ".join(words[i % 7 :] * (1 + i % 3)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    units = lm_score.gather_units(docs)
    model = lm_score.train(units, *lm_score.count_bits(units))
    every = [bytes(r.unit) for r in units.collect()]
    found = lm_score.frequent_costs(units, model)
    assert sorted(found) == sorted(every)
    for unit in every:  # alone, so nothing is shared with other units
        assert found[unit] == pytest.approx(float(model.cost([unit])[0]), rel=1e-12)
    looked_at = []
    slots = lm_score._slots
    monkeypatch.setattr(lm_score, "_slots", lambda flat, c: looked_at.append(len(flat)) or slots(flat, c))
    model.cost([b"press ", b"pressed ", b"pressing "])
    assert sum(looked_at) == len(b"press ") + len(b"ed ") + len(b"ing ")
    monkeypatch.undo()
    monkeypatch.setattr(lm_score, "FREQUENT", 3)
    assert len(lm_score.frequent_costs(units, model)) <= 3
    monkeypatch.setattr(lm_score, "REMEMBERED", 2)
    after = {r.doc_id: r.score for r in lm_score.score(docs).collect()}
    assert after == {k: pytest.approx(v, rel=1e-12) for k, v in before.items()}


def test_segmenting_tasks_give_their_memory_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segment, "give_back", lambda: open(f"{tmp_path}/given", "w").close())
    rows = segment.encode(spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")).collect()
    assert len(rows) == 2 and all(r.round_trip for r in rows)
    assert (tmp_path / "given").exists()


def test_units_a_worker_meets_are_numbered_and_their_words_added_up():
    known = {b"some": 9, b"more": 99}
    numbers, facts = lm_score._Numbers(), lm_score._facts([], np.zeros(0), known)
    texts = [b"Some rare\tmore rare", b"", b"rare more more some other"]
    found = [np.array([numbers[u] for u in lm_score.units_of(t)], np.int32) for t in texts]
    new = sorted(numbers)
    places = np.array([numbers[u] for u in new])
    facts = facts.extended(lm_score._facts(new, np.array([float(len(u)) for u in new]), known).moved(places))
    rows = lm_score.pa.RecordBatch.from_pydict({"row": [0, 1, 2], "doc_id": [7, 8, 9], "text": texts})
    got = facts.batch(rows, found).to_pylist()
    assert [(r["n_tokens"], r["n_known"], r["bits"], r["n_bytes"]) for r in got] == [(5, 2, 20, 19), (1, 0, 1, 0), (6, 3, 26, 25)]
    assert [round(r["sums"], 9) for r in got] == [3, 0, 5]
    rare = [sorted(zip(r["rare"], r["times"])) for r in got]
    assert rare == [[(b"rare", 1), (b"rare", 1)], [], [(b"other", 1), (b"rare", 1)]]
