"""License scans with a positional rare-token index, in DataFrame functions only.

Every template is indexed by its rarest words, rarity being the inverse document frequency of licence words in
the scanned documents. A document looks up all its words in the index; each hit proposes one position of one
template (word position less the word's position in the template). A proposal is scored by the share of the
template's rarity that stands at the proposed relative positions, and holds when mandatory phrases stand there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.texts import bind, lower_ascii

WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text``: lower-cased words of a notice. ``phrases``: word runs it must hold, near where it is proposed.

    ``exact``: all of the words must stand in a row; otherwise a share ``least`` of the rarity. A word put in or left out
    moves what follows off its places, so long notices ask for less than a half: either side of the gap suffices.
    """

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    exact: bool = False
    least: float = 0.6

    @property
    def words(self) -> list[str]:
        return self.text.split()


# The base phrases and their labels.
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)

# Opening or operative words of well-known licences.
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted",
        ("permission to use copy modify", "is hereby granted"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
        " with the license",
        ("apache license",),
        least=0.4,
    ),
    Template(
        "gpl-3",
        "licensed under the gnu general public license version 3",
        ("gnu general public license", "version 3"),
    ),
    Template(
        "gpl-2",
        "licensed under the gnu general public license version 2",
        ("gnu general public license", "version 2"),
    ),
    Template(
        "lgpl",
        "licensed under the gnu lesser general public license version",
        ("lesser general public license",),
    ),
    Template(
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 3 of the license or at your"
        " option any later version",
        ("gnu general public license", "version 3"),
        least=0.4,
    ),
    Template(
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 2 of the license or at your"
        " option any later version",
        ("gnu general public license", "version 2"),
        least=0.4,
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
        " general public license as published by the free software foundation either version 2 1 of the license or"
        " at your option any later version",
        ("lesser general public license",),
        least=0.4,
    ),
    Template(
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero"
        " general public license as published by the free software foundation either version 3 of the license or"
        " at your option any later version",
        ("affero general public license",),
        least=0.4,
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("unencumbered software", "public domain"),
    ),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",), least=0.5),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",), least=0.5),
    Template("proprietary", "all rights reserved", exact=True),
)

#: Words each notice is looked up by, its rarest.
RARE = 3
#: Words on either side of a proposed place in which mandatory phrases may stand.
SLACK = 12


def alnum_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    lowered = lower_ascii(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(lowered, WORD_GAP), lambda w: w != "")


def rarity(docs: DataFrame, templates: Sequence[Template], text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each template word; as many numbers as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.filter(alnum_words(F.col(text_col)), lambda w: w.isin(vocabulary))
    # The empty word, which no text holds, stands for the document itself: one scan gives all counts.
    rows = docs.select(F.explode(F.concat(F.array_distinct(words), F.array(F.lit("")))).alias("word"))
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in counts.collect()}  # one row for each template word at most, and one
    total = found.pop("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 0.01 for w in vocabulary}


def _lookup_words(template: Template, idf: dict[str, float]) -> list[str]:
    ranked = sorted(set(template.words), key=lambda w: (-idf[w], w))
    return ranked[: 1 if template.exact else RARE]


def _index(templates: Sequence[Template], idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) by rare word."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        rare = _lookup_words(template, idf)
        for position, word in enumerate(template.words):
            if word in rare:
                postings.setdefault(word, []).append((number, position))
    return postings


def _proposals(words: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """Distinct (template, start) that the document's rare words propose; a start may be before the text."""
    rare = sorted(postings)
    table = F.create_map(
        *(
            x
            for word in rare
            for x in (
                F.lit(word),
                F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[word])),
            )
        )
    )
    hits = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))),
        lambda hit: hit.isNotNull(),
    )
    return F.array_distinct(
        F.flatten(
            F.transform(
                hits,
                lambda hit: F.transform(
                    table[hit["w"]],
                    lambda at: F.struct(at["t"].alias("t"), (hit["i"] - at["p"]).cast("int").alias("start")),
                ),
            )
        )
    )


def _matched(words: Column, start: Column, template: Template, idf: dict[str, float]) -> Column:
    """Share of the template's rarity that stands at its relative positions, 0 where a phrase lacks."""
    size = len(template.words)
    if template.exact:
        inside = (start >= 0) & (start + size <= F.size(words))
        same = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.lit(size)) == F.array(*map(F.lit, template.words))
        return F.when(inside & same, F.lit(1.0)).otherwise(F.lit(0.0))
    total = sum(idf[w] for w in template.words)
    score = sum(
        (
            F.when(F.get(words, start + k).eqNullSafe(F.lit(w)), F.lit(idf[w] / total)).otherwise(F.lit(0.0))
            for k, w in enumerate(template.words)
        ),
        F.lit(0.0),
    )
    low = F.greatest(start - SLACK, F.lit(0))
    near = F.concat(
        F.lit(" "), F.array_join(F.slice(words, low + 1, F.greatest(start + size + SLACK - low, F.lit(0))), " "), F.lit(" ")
    )
    phrases = F.lit(True)
    for phrase in template.phrases:
        phrases = phrases & F.contains(near, F.lit(f" {phrase} "))
    return F.when((score >= template.least) & phrases, F.least(score, F.lit(1.0))).otherwise(F.lit(0.0))


MATCHES = "array<struct<t:int,start:int,share:double>>"


def scan(
    docs: DataFrame,
    phrases: Sequence[Template] = PHRASES,
    notices: Sequence[Template] = NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, places (phrase label and first word of each exact phrase), notices (label,
    first word and matched share of each accepted notice).

    Missing and empty texts have no words and no licence. Repeated rows each get a row; other columns are left
    aside. No document is shuffled; only counts of licence words are.
    """
    templates = [*phrases, *notices]
    idf = rarity(docs, templates, text_col)
    postings = _index(templates, idf)

    def share_of(words: Column, at: Column) -> Column:
        chosen = F.lit(0.0)
        for number, template in reversed(list(enumerate(templates))):
            chosen = F.when(at["t"] == number, _matched(words, at["start"], template, idf)).otherwise(chosen)
        return chosen

    def matches(words: Column) -> Column:
        scored = F.transform(
            _proposals(words, postings),
            lambda at: F.struct(at["t"].alias("t"), at["start"].alias("start"), share_of(words, at).alias("share")),
        )
        return F.array_sort(F.filter(scored, lambda m: m["share"] > 0))

    labels = F.array(*(F.lit(t.label) for t in templates))
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        bind(
            alnum_words(F.col(text_col)),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), matches(w).alias("matches")),
        ).alias("found"),
    ).select("doc_id", "found.n_words", "found.matches")

    def named(keep) -> Column:
        return F.transform(
            F.filter("matches", keep),
            lambda m: F.struct(
                F.get(labels, m["t"]).alias("label"), m["start"].cast("long").alias("start"), m["share"].alias("share")
            ),
        )

    return found.select(
        "doc_id",
        "n_words",
        named(lambda m: m["t"] < len(phrases)).alias("places"),
        named(lambda m: m["t"] >= len(phrases)).alias("notices"),
    )


def label_list(found: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
