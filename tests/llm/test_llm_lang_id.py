from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from footfall.llm import lang_id, queries
from footfall.llm.lang_id import LangId, UNDETERMINED

SYLLABLES = {"aa": "ka ki ku ke ko".split(), "bb": "lé ra sü ti no".split(), "cc": "ба да га на ло".split()}


def sentence(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(words))


def rows_of_languages(rng, count):
    return [(k, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(1, 20)), lang, "s") for k in range(count)]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def brute_force(rows, rule):
    """(id, held out, language, score) with every table counted and every word scored anew; texts below the sample's size."""
    learnt = {(lang, text) for k, text, lang, *_ in rows if not held_out(k) and lang is not None and text is not None}
    counts = {}
    for lang, text in learnt:
        for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            counts.setdefault((lang, 0), Counter())[word] += 1
            for size in range(1, rule.longest + 1):
                for k in range(len(word) + 3 - size):
                    counts.setdefault((lang, size), Counter())[f" {word} "[k : k + size]] += 1
    langs = sorted({lang for lang, _ in counts})
    kept = {}
    for (lang, size), counter in counts.items():
        for token, n in counter.items():
            if size or n >= rule.least:
                kept.setdefault(size, {}).setdefault(token, {})[lang] = n

    def logs(size, token):
        return np.array([
            math.log((kept[size][token].get(lang, 0) + rule.smoothing)
                     / (sum(counts.get((lang, size), {}).values()) + rule.smoothing * len(kept[size])))
            for lang in langs
        ])

    def score(word):
        if word in kept.get(0, {}):
            return logs(0, word)
        marked, found = f" {word} ", []
        for k in range(len(marked)):
            for size in range(min(rule.longest, len(marked) - k), 0, -1):
                if (run := marked[k : k + size]) in kept.get(size, {}):
                    if run != " ":
                        found.append(logs(size, run))
                    break
        return np.mean(found, axis=0) if found else np.zeros(len(langs))

    out = []
    for k, text, *_ in rows:
        words = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
        if not words or not langs:
            out.append((k, held_out(k), UNDETERMINED, 0.0))
            continue
        total = sum(map(score, words))
        best = int(np.argmax(total))
        out.append((k, held_out(k), langs[best], float(1 / np.exp(total - total[best]).sum())))
    return out


def same(found, wanted):
    found = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in found), key=repr)
    wanted = sorted(wanted, key=repr)
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in wanted])
    assert all(0 <= r[3] <= 1 for r in found)


def test_predictions_equal_the_brute_force(spark):
    rows = rows_of_languages(random.Random(1), 300) + [
        (900, "kakaka ΩΩΩ", None, None), (901, "12 34 -- ²½", "aa", "s"), (902, None, "bb", "s"), (903, "ΩΩΩ", None, "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    same(lang_id.identify(docs).collect(), brute_force(rows, LangId()))


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    same(lang_id.identify(edge_docs).collect(), brute_force([r[:4] for r in edge_rows], LangId()))
    assert lang_id.identify(no_docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert lang_id.identify(unlabelled).collect()[0]["lang_pred"] == UNDETERMINED


def test_labels_sources_and_ids_are_no_inputs(spark):
    rows = rows_of_languages(random.Random(2), 200)
    other = [(k, t, None if held_out(k) else lang, "elsewhere") for k, t, lang, _ in rows]
    schema = "doc_id long, text string, lang string, source string"
    one, two = (lang_id.identify(spark.createDataFrame(r, schema)).orderBy("doc_id").collect() for r in (rows, other))
    assert one == two


def test_a_remembered_word_is_forgotten_and_scored_again(monkeypatch):
    monkeypatch.setattr(lang_id, "_REMEMBERED", 4)
    monkeypatch.setattr(lang_id, "_AT_ONCE", 2)
    model = lang_id.Model(["x", "y"], [{"known": 0}, {c: k for k, c in enumerate("abcdef")}], [np.array([[-1.0, -2.0]]), np.arange(12.0).reshape(6, 2)])
    scorer = lang_id.Scorer(model)
    words = ["a", "b", "c", "known", "d", "e", "f", "a", "known"] * 3
    expected = sum(model.scores[0][0] if w == "known" else model.backed_off(w) for w in words)
    assert np.allclose(scorer.total(words), expected)


def test_held_out_documents_get_their_language(spark):
    found = queries.QUERIES["op13_lang_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_the_sample_is_bounded_and_balanced(spark):
    rows = [(k, sentence(random.Random(k), "aa" if k % 50 else "bb", 6), "aa" if k % 50 else "bb") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("lang", "cast(text as binary) text")
    sizes = {r["lang"]: r["count"] for r in lang_id.labelled_sample(docs, LangId(rows=300)).groupBy("lang").count().collect()}
    assert 200 < sizes["aa"] < 400 and sizes["bb"] > 60
