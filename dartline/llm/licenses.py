"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of WINDOW words of a longer line (windows overlap by half), or, for a
template of n words, repeats counted, any window of n + n // 4 words of the text, whatever the line ends:
a notice is found however it is wrapped, and whatever its length, with up to a fifth of other words. A block
meets a template when it holds at least `threshold` of the template's distinct words. The join orders
words by how many documents hold them, rarest first. Its filters lose nothing:
prefix: a block that meets a template of n words, m of them needed, holds one of its n - m + 1 rarest;
length: it has at least m distinct words; positional: a block whose first common word stands at place i
of the template can hold n - i words of it at most.
Templates are a bounded parameter (TEMPLATE_WORDS distinct words at most) and go to every task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dartline.llm.common import mapped, row_slices, table

THRESHOLD = 0.8
WINDOW = 64
TEMPLATE_WORDS = 10_000
#: Phrases whose every place counts, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: License statements and their labels: fixed values.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Bytes outside a word -> space, A-Z -> a-z; a line end stays itself.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 10 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(KEPT)


def blocks(line: list[bytes]) -> list[list[bytes]]:
    if len(line) <= WINDOW:
        return [line]
    half = WINDOW // 2
    return [line[i : i + WINDOW] for i in range(0, len(line) - half, half)]


class Templates:
    """Templates with their words in the order of `frequency`, and an index of their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.labels, self.words, self.needed, self.sizes, self.index = [], [], [], [], {}
        for label, text in templates:
            every = plain(text).split()
            words = sorted(set(every), key=lambda w: (frequency.get(w, 0), w))
            if not words:
                continue
            t, need = len(self.words), max(1, math.ceil(threshold * len(words) - 1e-9))
            self.labels.append(label)
            self.words.append(words)
            self.needed.append(need)
            self.sizes.append(len(every) + len(every) // 4)
            for i, w in enumerate(words[: len(words) - need + 1]):
                self.index.setdefault(w, []).append((t, i))

    def matches(self, held: set[bytes], probes: set[bytes]):
        """(template, containment) of the templates that a block's distinct words meet; probes: those in a prefix."""
        first: dict[int, int] = {}
        for w in probes:
            for t, i in self.index[w]:
                first[t] = min(i, first.get(t, i))
        for t, i in first.items():
            words, need = self.words[t], self.needed[t]
            if len(held) < need or len(words) - i < need:  # length; positional
                continue
            common = sum(w in held for w in words[i:])
            if common >= need:
                yield t, common / len(words)


def windows(words: list[bytes], own: list[bytes], size: int, need: int):
    """(first word, last word, distinct words) of the fullest window of each run of overlapping windows of
    `size` words that hold `need` of the words in `own`; first and last are such words."""
    wanted = frozenset(own)
    places = [i for i, w in enumerate(words) if w in wanted]
    times: dict[bytes, int] = {}
    low, best = 0, None
    for high, at in enumerate(places):
        times[words[at]] = times.get(words[at], 0) + 1
        while at - places[low] >= size:
            gone = words[places[low]]
            times[gone] -= 1
            if not times[gone]:
                del times[gone]
            low += 1
        if len(times) >= need:
            if best and places[low] > last:
                yield best
                best = None
            last = at
            if not best or len(times) > best[2]:
                best = places[low], at, len(times)
    if best:
        yield best


def scan(text: str | None, templates: Templates, phrases) -> dict:
    """A text's base counts, labels, score and the word spans of the blocks that meet a template."""
    body = plain(text)
    words = body.split()
    lines = [line.split() for line in body.split(b"\n")]
    n, labels, base_labels, places, score, spans = 0, set(), set(), [], 0.0, []
    firsts = {p[0]: [q for q in phrases if q[0][0] == p[0]] for p, _ in phrases}
    likely = any(p[-1] in body for p, _ in phrases)
    if likely:
        ends = {p[0] for p, _ in phrases}
        for i, w in enumerate(words):
            if w in ends:
                for p, label in firsts[w]:
                    if tuple(words[i : i + len(p)]) == p:
                        places.append(i)
                        base_labels.add(label)
    prefixes, whole = templates.index.keys(), {}
    held = set(words)
    for t, _ in templates.matches(held, held & prefixes):  # no window holds more than the whole text
        whole[t] = []
    for line in lines if whole else ():
        if not prefixes.isdisjoint(line):
            for k, block in enumerate(blocks(line)):
                held = set(block)
                for t, share in templates.matches(held, held & prefixes):
                    labels.add(templates.labels[t])
                    score = max(score, share)
                    at = n + k * (WINDOW // 2)
                    whole[t].append((at, at + len(block) - 1, share))
                    spans.append({"label": templates.labels[t], "first_word": at, "last_word": at + len(block) - 1, "containment": share})
        n += len(line)
    for t, found in whole.items():
        own = templates.words[t]
        for first, last, common in windows(words, own, templates.sizes[t], templates.needed[t]):
            share = common / len(own)
            if not any(a <= first and last <= z and share <= held for a, z, held in found):  # a line block told of it
                labels.add(templates.labels[t])
                score = max(score, share)
                spans.append({"label": templates.labels[t], "first_word": first, "last_word": last, "containment": share})
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels | base_labels)), "score": max(score, 1.0 if places else 0.0), "spans": spans,
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, last_word long, containment double>>"


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each of the templates' words: at most TEMPLATE_WORDS rows, summed in each task first."""
    wanted = frozenset(w for _, text in templates for w in plain(text).split())
    if len(wanted) > TEMPLATE_WORDS:
        raise ValueError(f"the templates have more than {TEMPLATE_WORDS} distinct words")

    def run(batches):
        import pyarrow as pa

        counts = dict.fromkeys(wanted, 0)
        for rows in row_slices(batches):
            for text in rows["text"]:
                for w in wanted.intersection(plain(text).split()):
                    counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    found = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row of SCHEMA for every row of docs; extra columns are ignored.

    A null or empty text has no words, no labels and score 0. score: 1 if a phrase stands in the text,
    else the largest share of a template that one block holds (0 if none reaches the threshold).
    """
    frequency = frequencies(docs, templates)
    phrases = [(tuple(p.encode().split()), label) for p, label in phrases]

    def run(rows):
        index = Templates(templates, frequency, threshold)
        for r in rows:
            yield {"doc_id": r["doc_id"]} | scan(r["text"], index, phrases)

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    """The same in DuckDB's SQL: all templates against all blocks."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    rows = []
    for label, text in TEMPLATES:
        words = sorted({w.decode() for w in plain(text).split()})
        rows.append(f"('{label}', [{quoted(words)}], {max(1, math.ceil(THRESHOLD * len(words) - 1e-9))})")
    hits = []
    for phrase, label in PHRASES:
        words = phrase.split()
        same = " AND ".join(f"k[i + {j}] = '{w}'" for j, w in enumerate(words, 1))
        hits.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(k) - {len(words) - 1}), lambda i: {same})) AS at_word FROM w")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    half = WINDOW // 2
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS k FROM documents),
h AS MATERIALIZED ({' UNION ALL '.join(hits)}),
b AS (SELECT doc_id, count(*) AS n, min(at_word) AS a, max(at_word) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id),
l AS (SELECT doc_id, regexp_extract_all(unnest(string_split({lower}, chr(10))), '{word}') AS k FROM documents),
x AS MATERIALIZED (SELECT doc_id, list_distinct(unnest(CASE WHEN len(k) <= {WINDOW} THEN [k] ELSE list_transform(range(0, len(k) - {half}, {half}), lambda i: k[i + 1:i + {WINDOW}]) END)) AS k FROM l),
t(label, words, needed) AS (VALUES {', '.join(rows)}),
m AS (SELECT doc_id, label, len(list_intersect(k, words)) / len(words)::DOUBLE AS share FROM x, t WHERE len(list_intersect(k, words)) >= needed),
y AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM h) GROUP BY doc_id),
v AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, len(k)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
 coalesce(y.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(v.share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN v USING (doc_id)
"""


OP9_SQL = _sql()
