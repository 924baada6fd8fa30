"""License notices by exact set-similarity join.

Templates are sets of words. A block is a window of a document's words, twice as long as the
template (at least MIN_WINDOW words), at any place; it joins the template when it holds at
least the template's threshold of its words (containment). It is enough to look at windows
that begin with a word of the template. Words are ordered by their frequency in all documents,
rarest first. Then
* prefix filter: a block that joins has one of the template's r - need + 1 rarest words,
* length filter: it has at least `need` words of it,
* positional filter: from the place of the block's first word in the template's order on,
  enough words are left.
What passes is verified by counting. The filters only spare work: every block that meets the
threshold is found. Frequencies are only ever needed of template words, so their table is
bounded by the templates; documents are read twice and never shuffled.

Short phrases are templates with threshold 1 and blocks of their own length, whose words must
stand consecutively. Templates may be of any length.

Cases: a null text has no words; repeated rows stay; a word of a template that the documents
never hold has frequency zero and comes first; long texts are cut into many windows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trailhound.llm.common import map_batches

MIN_WINDOW = 64
CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as they are commonly written, and their labels.
NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl",
    "All rights reserved.": "reserved",
    # Headers and bodies.
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation
    the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
    to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
    copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software.""": "mit",
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
    the following disclaimer in the documentation and/or other materials provided with the distribution.""": "bsd",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
    with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless
    required by applicable law or agreed to in writing, software distributed under the License is distributed on an
    "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""": "apache",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
    later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
    even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""": "gpl",
}

#: Bytes of words stay, capitals become small, all else is space.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    threshold: float
    phrase: bool

    @property
    def need(self) -> int:
        return ceil(self.threshold * len(set(self.words)) - 1e-9)

    @property
    def window(self) -> int:
        return len(self.words) if self.phrase else max(MIN_WINDOW, 2 * len(self.words))


def built_in_templates() -> list[Template]:
    return [Template(label, tuple(words_of(p)), 1.0, True) for p, label in PHRASES.items()] + [
        Template(label, tuple(words_of(p)), CONTAINMENT, False) for p, label in NOTICES.items()
    ]


class Joiner:
    """The templates' side of the join: ordered words and the index of their prefixes."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int]):
        vocabulary = {w for t in templates for w in t.words}
        order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = templates
        self.sets = [sorted({self.rank[w] for w in t.words}) for t in templates]
        self.prefix = [ranks[: len(ranks) - t.need + 1] for t, ranks in zip(templates, self.sets)]
        self.prefix_words = frozenset(order[r] for ranks in self.prefix for r in ranks)

    def blocks(self, t: int, places: dict[int, list[int]]) -> Iterator[tuple[int, int]]:
        """(first word, words in common) of the windows that may join template t."""
        own, need, width = self.sets[t], self.templates[t].need, self.templates[t].window
        marks = sorted(p for r in self.prefix[t] for p in places.get(r, ()))
        if not marks:
            return
        hits = sorted((p, at) for at, r in enumerate(own) for p in places.get(r, ()))
        end = 0
        for begin, (first, _) in enumerate(hits):
            while end < len(hits) and hits[end][0] < first + width:
                end += 1
            mark = bisect_left(marks, first)
            if end - begin < need or mark == len(marks) or marks[mark] >= first + width:
                continue
            block = {at for _, at in hits[begin:end]}
            if len(own) - min(block) >= need:
                yield first, len(block)

    def scan(self, text: str | None) -> tuple:
        """n_words, places of phrases (first word, label), labels of all kinds, score."""
        words = words_of(text)
        found, labels, score = [], set(), 0.0
        if self.prefix_words.isdisjoint(words):
            return len(words), found, labels, score
        places: dict[int, list[int]] = {}
        for i, r in enumerate(map(self.rank.get, words)):
            if r is not None:
                places.setdefault(r, []).append(i)
        for t, template in enumerate(self.templates):
            most = 0
            for start, common in self.blocks(t, places):
                if template.phrase and words[start:start + template.window] == list(template.words):
                    found.append((start, t))
                most = max(most, common)
            if not template.phrase and most >= template.need:
                labels.add(template.label)
                score = max(score, most / len(self.sets[t]))
        score = 1.0 if found else score
        return len(words), [(i, self.templates[t].label) for i, t in sorted(found)], labels, score


def frequencies(docs: DataFrame, templates: list[Template]) -> dict[bytes, int]:
    """How often each template word stands in all documents."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update(filter(vocabulary.__contains__, words_of(text)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, places (start, label) of phrases, labels of notices, score."""
    templates = templates or built_in_templates()
    joiner = Joiner(templates, frequencies(docs, templates))

    def work(rows: dict) -> dict:
        found = [joiner.scan(t) for t in rows["text"]]
        return {
            "doc_id": rows["doc_id"], "n_words": [f[0] for f in found],
            "places": [[{"start": i, "label": x} for i, x in f[1]] for f in found],
            "notices": [sorted(f[2]) for f in found], "score": [f[3] for f in found],
        }

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work,
        "doc_id long, n_words long, places array<struct<start:long,label:string>>, notices array<string>, score double",
    )


def digest(found: DataFrame) -> DataFrame:
    own = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, "notices")).alias("labels"), "score",
    )


def oracle_sql() -> str:
    """DuckDB: the same result by counting every window's words, without any filter."""
    rows = [
        (t, template.label, "true" if template.phrase else "false", template.need, i, w.decode())
        for t, template in enumerate(built_in_templates()) for i, w in enumerate(template.words)
    ]
    values = ",\n".join(f"({t},'{label}',{phrase},{need},{i},'{w}')" for t, label, phrase, need, i, w in rows)
    return f"""
WITH template(t, label, phrase, need, i, w) AS (VALUES {values}),
size AS (SELECT t, any_value(label) AS label, any_value(phrase) AS phrase, any_value(need) AS need,
    count(DISTINCT w) AS words, count(*) AS width, greatest({MIN_WINDOW}, 2 * count(*)) - 1 AS span FROM template GROUP BY t),
list AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM list),
own AS (SELECT * FROM word SEMI JOIN template USING (w)),
hit AS (SELECT r, t, pos, own.w, span FROM own JOIN (SELECT DISTINCT t, w FROM template WHERE NOT phrase) USING (w) JOIN size USING (t)),
pair AS (SELECT r, t, count(DISTINCT w) OVER (PARTITION BY r, t ORDER BY pos RANGE BETWEEN CURRENT ROW AND span FOLLOWING) AS common FROM hit),
notice AS (SELECT DISTINCT r, label, common / words AS share FROM pair JOIN size USING (t) WHERE NOT phrase AND common >= need),
place AS (SELECT r, t, pos - i AS start FROM own JOIN template USING (w) JOIN size USING (t) WHERE size.phrase
    GROUP BY r, t, pos - i HAVING count(*) = any_value(width)),
base AS (SELECT r, count(*) AS n, min(start) AS a, max(start) AS z, list(DISTINCT label) AS labels
    FROM place JOIN size USING (t) GROUP BY r),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM notice GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM list LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""
