"""License scans, quality rules, secrets and personal data against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from footfall.llm import license_scan, pii, quality, secret_scan

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# --- License scans -------------------------------------------------------------------------------------------


def phrase_places(text):
    words = ALNUM.findall(lower_ascii(text or ""))
    return len(words), sorted(
        (k, t.label)
        for t in license_scan.PHRASES
        for k in range(len(words))
        if words[k : k + len(t.words)] == t.words
    )


def test_license_places_equal_plain_search(edge_docs, edge_rows):
    got = license_scan.scan(edge_docs)
    wanted = Counter()
    for row in edge_rows:
        n, places = phrase_places(row[1])
        wanted[(row[0], n, tuple(places))] += 1
    found = Counter(
        (r.doc_id, r.n_words, tuple(sorted((p.start, p.label) for p in r.places))) for r in got.collect()
    )
    assert found == wanted


def test_license_notices_tolerate_gaps_but_need_their_phrases(spark):
    texts = [
        "Permission is hereby granted, free of charge, to ANY person obtaining a copy of this software and"
        " associated documentation files, to deal in the software without restriction",
        "permission to read these documentation files is granted to any person without restriction",
        "All rights reserved.",
        "licensed under the GNU General Public License, version 3",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: [n.label for n in r.notices] for r in license_scan.scan(docs).collect()}
    assert labels == {0: ["mit"], 1: [], 2: ["proprietary"], 3: ["gpl-3"]}


def test_usual_licence_headers_are_found_with_words_put_in_or_left_out(spark):
    gnu = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    )
    texts = [
        gnu.format(3), gnu.format(2), gnu.format(3).replace("published", "once published"), gnu.format(2).replace("and/or modify it ", ""),
        gnu.format(3).replace("General", "Affero General"), gnu.format("2.1").replace("General", "Lesser General").replace("program", "library"),
        "This program is free software, and the Free Software Foundation once published a public license.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100 + k, "a plain note on other things") for k in range(20)], "doc_id long, text string")
    labels = {r.doc_id: sorted({n.label for n in r.notices}) for r in license_scan.scan(docs).collect()}
    assert [labels[k] for k in range(7)] == [["gpl-3"], ["gpl-2"], ["gpl-3"], ["gpl-2"], ["agpl-3"], ["lgpl"], []]
    assert not any(labels[100 + k] for k in range(20))


def plain_notices(texts, templates):
    """Every template at every place, scored by the definition."""
    rows = [[w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", t.lower()) if w] for t in texts]
    vocabulary = {w for t in templates for w in t.words}
    idf = {w: math.log((len(rows) + 1) / (sum(w in r for r in rows) + 1)) + 0.01 for w in vocabulary}
    out = []
    for words in rows:
        found = set()
        for t in templates:
            size, total = len(t.words), sum(idf[w] for w in t.words)
            rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[: 1 if t.exact else license_scan.RARE]
            for start in range(-size, len(words)):
                agree = [w for k, w in enumerate(t.words) if 0 <= start + k < len(words) and words[start + k] == w]
                low = max(start - license_scan.SLACK, 0)
                near = f" {' '.join(words[low : max(start + size + license_scan.SLACK, 0)])} "
                share = sum(idf[w] for w in agree) / total
                held = len(agree) == size if t.exact else share >= t.least and all(f" {p} " in near for p in t.phrases)
                if held and any(w in rare for w in agree):
                    found.add((t.label, start, round(min(share, 1.0), 9)))
        out.append(found)
    return out


def test_license_notices_equal_every_template_at_every_place(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(120):
        words = []
        for template in rng.sample(license_scan.NOTICES, rng.randint(0, 2)):
            words += ["note"] * rng.randint(0, 15)
            words += [w for w in template.words if rng.random() > rng.choice((0, 0.03, 0.1))]
            words[rng.randrange(len(words) + 1) : 0] = ["indeed"] * rng.randint(0, 1)
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: {(n.label, n.start, round(n.share, 9)) for n in r.notices} for r in license_scan.scan(docs).collect()}
    wanted = plain_notices(texts, license_scan.NOTICES)
    assert sum(map(len, wanted)) > 80
    assert [got[k] for k in range(len(texts))] == wanted


def test_license_scan_uses_no_python_and_no_shuffle_of_documents(spark, edge_docs):
    plan = license_scan.scan(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_license_scan_of_nothing(no_docs):
    assert license_scan.scan(no_docs).collect() == []


# --- Quality rules -------------------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    words = BLANK.findall(text)
    at = defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    repeated = {p for places in at.values() if len(places) > 1 for k in places for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
        len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts_equal_plain_counts(edge_docs, edge_rows):
    got = rows_of(quality.assess(edge_docs), "doc_id", *COUNTS)
    assert got == Counter((r[0], *plain_quality(r[1])) for r in edge_rows)


def hosts(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        own = " ".join(f"w{rng.randrange(900)}" for _ in range(30))
        text = f"Subscribe to our letter number {k % 10}!\n{own}" if k < 30 else own
        rows.append((k, text, "news"))
    rows += [(100 + k, "Subscribe to our letter number 7!\n" + "only a few words", "news") for k in range(3)]
    rows += [(200 + k, rows[0][1], "copies") for k in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_lines_of_many_documents_go_and_depleted_documents_with_them(spark):
    docs, rows = hosts(spark)
    rules = quality.LineRules(limits=((0, 20),))
    got = {r.doc_id: r for r in quality.assess(docs, rules).collect()}
    # Digits are normalised, so the ten letters are one line; copies of one text are one document.
    assert all(got[k].n_removed_words == 6 and got[k].kept for k in range(30))
    assert all(got[k].n_removed_words == 0 and got[k].kept for k in [*range(30, 60), *range(200, 280)])
    assert all(not got[100 + k].kept for k in range(3))
    cleaned = {r.doc_id: r.text for r in quality.clean(docs, rules).collect()}
    assert cleaned[3] == rows[3][1].split("\n")[1] and cleaned[200] == rows[0][1] and 100 not in cleaned


def test_limits_are_numbers_of_documents_and_not_shares_of_a_host(spark):
    rng = random.Random(5)
    passage = " ".join(f"passage{k}" for k in range(60))
    rows = []
    for k in range(3000):
        own = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(15))
        short = "Thank you." if k % 4 == 0 else f"See {own[:20]}"  # 750 texts: below the limit of short lines
        rows.append((k, f"{own}\n{short}" + (f"\n{passage}" if k < 50 else ""), "big"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed_words for r in quality.assess(docs).collect()}
    assert all(got[k] == (60 if k < 50 else 0) for k in got)


def test_cleaning_keeps_columns_and_repeated_rows(edge_docs, no_docs):
    kept = quality.clean(edge_docs)
    assert kept.columns == edge_docs.columns and kept.schema == edge_docs.schema
    failed = {r.doc_id for r in quality.assess(edge_docs).where("NOT kept").collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 3 and not ({0, 1, 2, 3, 4} & set(ids)) and {0, 1, 2, 3, 4} <= failed
    assert quality.clean(no_docs).collect() == []


def test_quality_rules_use_no_python(edge_docs):
    plan = quality.assess(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- Personal data -------------------------------------------------------------------------------------------

PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (
        re.compile(r"[0-9]([\x20-]?[0-9])+"),
        lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d),
    ),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_pii(text):
    return sorted(
        (m.start(), list(PII).index(kind), m.end(), kind)
        for kind, (pattern, good) in PII.items()
        for m in pattern.finditer(text)
        if good(m[0])
    )


def test_personal_data_equals_patterns_on_random_texts():
    rng = random.Random(11)
    parts = ["a@b.cd", "@", "+", "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "-", " ", ".", "x", "7", "(", ")", "\n",
             "joe.b+c@mail-x.org", "00012.0.0.1", "é", "12345678901234567890123", "@@", "a.b@c", "4-1", "DE"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        got = [(s, e, k) for s, e, k in pii.find_spans(text) if k in PII]
        assert got == [(s, e, k) for s, _, e, k in plain_pii(text)], text


def test_luhn_knows_published_numbers():
    assert pii.luhn("4111111111111111") and pii.luhn("79927398713") and not pii.luhn("79927398710")


def test_accounts_and_logins():
    text = "pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not DE89370400440532013001; ftp://joe:pw@host.io/x"
    assert [(text[s:e], k) for s, e, k in pii.find_spans(text) if k in ("iban", "login")] == [
        ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"), ("ftp://joe:pw@host.io", "login"),
    ]


def test_personal_data_of_documents(spark, edge_docs, edge_rows, no_docs):
    got = Counter(
        (r.doc_id, tuple((s.start, s.end, s.kind) for s in r.spans)) for r in pii.detect(edge_docs).collect()
    )
    assert got == Counter((r[0], tuple(pii.find_spans(r[1] or ""))) for r in edge_rows)
    clean = pii.scrub(edge_docs)
    assert clean.schema == edge_docs.schema and clean.count() == len(edge_rows)
    text = clean.where("doc_id = 13").first().text
    assert text == "mail <EMAIL>, <PHONE> or <IP>; password=hunter22 token: abc"
    assert pii.detect(no_docs).collect() == [] and pii.scrub(no_docs).collect() == []


# --- Secrets -------------------------------------------------------------------------------------------------

SECRETS = {
    "assign": (
        re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m[2]) >= 6,
    ),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def test_base_secrets_equal_patterns_on_random_texts():
    rng = random.Random(3)
    parts = ["token", "=", ": ", "password", "PassWD", "api_key", "abcdef", "AKIA", "ABCDEFGH23456789", "deadbeef00112233",
             '"', "'", " ", "x", "secret", "Z", "\n", "_", "toKen=short", "0a" * 12]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        wanted = [
            (m.start(), m.end(), kind) for kind, (p, good) in SECRETS.items() for m in p.finditer(text) if good(m)
        ]
        assert sorted(secret_scan.base_spans(text)) == sorted(wanted), text


def test_battery_passes_random_strings_and_rejects_regular_ones():
    rng = random.Random(9)
    for encoding in ("hex", "base32", "base64"):
        chars = secret_scan.ENCODINGS[encoding]
        p = [secret_scan.random_p("".join(rng.choice(chars) for _ in range(64)), encoding) for _ in range(400)]
        assert sum(x < 0.001 for x in p) <= 4 and 0.3 < np.median(p) < 0.7
    assert secret_scan.random_p("0123456789abcdef" * 4, "hex") < 0.001
    assert secret_scan.random_p("aaaaaaaabbbbbbbb" * 3, "hex") < 0.001


def test_random_strings_are_found_in_prose_and_prose_is_not(spark):
    rng = random.Random(4)
    chars = secret_scan.ENCODINGS["base64"]
    keys = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(30)]
    rows = [(k, f"some ordinary prose with the key {key} in the middle of it") for k, key in enumerate(keys)]
    rows += [(100 + k, "internationalisation and counterrevolutionaries with uncharacteristically-long-words " * 3) for k in range(30)]
    rows += [(200, "THISISALLWRITTENINCAPITALSWITHOUTSPACES AND 123456789012345678901234"), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans if s.kind == "random"] for r in secret_scan.detect(docs).collect()}
    assert sum(bool(got[k]) for k in range(30)) >= 28
    assert not any(got[k] for k in [*range(100, 130), 200, 201])


def test_secrets_of_edge_documents(edge_docs, edge_rows, no_docs):
    found = secret_scan.detect(edge_docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in edge_rows)
    spans = next(r.spans for r in found if r.doc_id == 13)
    assert [(s.kind, s.start, s.end) for s in spans] == [("assign", 53, 70)]
    assert secret_scan.detect(no_docs).collect() == []


def test_false_discovery_limits_follow_the_step_up_rule(spark):
    rng = random.Random(1)
    depths = [min(60, int(rng.expovariate(0.5)) + 1) for _ in range(300)]
    rows = [([("random", 0, 20, d)],) for d in depths]
    found = spark.createDataFrame(rows, f"found {secret_scan.FOUND}")
    limit = secret_scan._limits(found)[0]
    ranked = sorted(depths, reverse=True)
    passed = [d for k, d in enumerate(ranked, 1) if 10.0**-d <= secret_scan.FALSE_SHARE * k / len(ranked)]
    assert limit == (min(passed) if passed else 61)


def test_every_tested_run_counts_and_mixed_separators_are_split():
    surprise = {c: 3.0 if c.isdigit() else 1.5 for c in secret_scan._VALUES["base64"]} | {"-": 2.0, "_": 2.0}
    dull = dict.fromkeys(surprise, 0.5)
    assert secret_scan.candidates("see some/ordinary/path here", dull) == [(4, 22, 0)]
    key = "q7Zr2XvB9kLmT4wYc8NdJ5hGs3PfA6eU"
    for text in (f"a-b/{key}", f"{key}-x/y", f"lib/{key}_old"):
        at = text.index(key)
        deep = [(s, e) for s, e, depth in secret_scan.candidates(text, surprise) if depth]
        assert len(deep) == 1 and deep[0][0] <= at and deep[0][1] >= at + len(key)
