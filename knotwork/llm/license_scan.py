"""License scan by diagonal voting.

The rolling word k-grams of all documents are hashed and joined, in Spark, to
the places of the same k-grams in a fixed table of templates: pairs for base
phrases and notices of up to SHORT words, runs of four for longer notices and
license bodies. Hits vote for the diagonal (document position minus template
position). A diagonal on which every pair of a base phrase hits is a place of
that phrase. For the others, neighbouring diagonals are merged as far as they
drift no more than an eighth of the template, so that a few words put in or left
out don't part them; a merged lane with enough votes is a candidate, and its span
is verified: the document's words there are laid beside the template's, in
order, and the share of the template that stands there is its score, which decides
on its label. Words that tell a license from its relatives (lesser, affero, nc, a
version's number) must stand where a template names them and may not where it
doesn't, and of different labels on one span the one with most words stands.

Defined cases: null and empty texts have no words and score 0; of rows sharing a
doc_id the one with the smallest text counts; texts of one word match nothing.
What one document's hits and candidates need gathers in a row, and grows with
that text's license words only.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base phrases, which count wherever their words stand together, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Widespread notices and license bodies, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""),
    ("bsd-3", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at https://mozilla.org/MPL/2.0/."""),
    ("boost", """Boost Software License - Version 1.0 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
http://creativecommons.org/licenses/by/4.0/"""),
]
#: Words that tell a license from its relatives. A template is only found where each of those it names stands, and
#: not where another one stands within or right beside its span.
TELLING = frozenset("lesser affero nc sa nd noncommercial sharealike noderivatives noderivs cc0 mozilla boost apache gnu".split())
#: A label that only says more than another one; all others compete for a span.
REFINES = {"gpl-3": "gpl", "bsd-3": "bsd"}
#: Words up to which a template is matched by pairs; the run of longer ones; diagonals up to so far apart are neighbours;
#: share of a template's k-grams that makes a candidate, and of its words that proves it.
SHORT, RUN, NEAR, VOTES, PROOF = 12, 4, 2, 0.25, 0.7  # a long template's neighbours: a sixteenth of its words
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(common.ASCII_LOWER))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    out = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        out = common.mixed(out * np.uint64(3) + h[j : len(h) - k + 1 + j]) if len(out) else out
    return out.view(np.int64)


def templates() -> list[tuple[str, list[str], bool, int]]:
    """label, words, whether it is a base phrase, k."""
    rows = [(label, p.split(), True) for p, label in BASE.items()] + [(label, words(t), False) for label, t in TEMPLATES]
    return [(*r, 2 if len(r[1]) <= SHORT else RUN) for r in rows]


def template_grams(spark: SparkSession) -> DataFrame:
    """key, phrase, at, k: about a thousand rows, fixed by the tables above."""
    rows = [(int(x), i, at, k) for i, (_, ws, _, k) in enumerate(templates()) for at, x in enumerate(_grams(common.word_hashes(" ".join(ws).encode()), k))]
    return spark.createDataFrame(rows, "key long, phrase int, at int, k int")


def word_grams(d: DataFrame) -> DataFrame:
    """doc_id, n_words, grams: the hashes of all pairs of neighbouring words, then those of all runs of RUN."""

    def start():
        def made(texts):
            found = [common.word_hashes(t.encode().lower(), common.NOT_WORD) for t in texts]  # lowers A-Z only: these are bytes
            return {"n_words": [len(h) for h in found], "grams": [np.concatenate([_grams(h, 2), _grams(h, RUN)]) for h in found]}

        return made

    return common.per_text(d, "n_words long, grams array<long>", start)


def _candidates(votes, table) -> tuple[list, list]:
    """(base phrases and their starts, merged lanes as phrase, first and last document position) of one document's votes."""
    base, lanes, out = [], {}, []
    for v in votes:
        _, ws, is_base, k = table[v["phrase"]]
        if not is_base:
            lanes.setdefault(v["phrase"], []).append((v["diagonal"], v["at"]))
        elif len(v["at"]) == len(ws) - k + 1:
            base.append((v["phrase"], v["diagonal"]))
    for phrase, found in lanes.items():
        _, ws, _, k = table[phrase]
        found.sort(key=lambda x: x[0])
        group = []
        for diagonal, at in [*found, (None, [])]:
            if group and (diagonal is None or diagonal - group[-1][0] > max(NEAR, len(ws) // 16) or diagonal - group[0][0] > max(NEAR, len(ws) // 8)):
                if len({a for _, ks in group for a in ks}) >= VOTES * (len(ws) - k + 1):
                    # as far as the whole template would reach on these diagonals
                    out.append((phrase, group[0][0], group[-1][0] + len(ws)))
                group = []
            group.append((diagonal, at))
    return sorted(base, key=lambda x: (x[1], x[0])), sorted(out)


def needed(template: list[str]) -> list[int]:
    """Places of the words that must stand: telling ones, and in short templates numbers after the word version."""
    numbers = [i + 1 for i, w in enumerate(template[:-1]) if w == "version" and template[i + 1].isdigit()] if len(template) <= SHORT else []
    return [i for i, w in enumerate(template) if w in TELLING] + numbers


def aligned(template: list[str], text: list[str], low: int, high: int) -> tuple[float, int, int]:
    """Share of the template's words that stand in order in text[low:high], and the span from the first to the last of them.

    The share is 0 where a needed word is missing, or where a telling word that the template doesn't name stands in the span or beside it.
    """
    low = max(0, low)
    blocks = [b for b in SequenceMatcher(None, template, text[low:high], autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, low, low
    start, end = low + blocks[0].b, low + blocks[-1].b + blocks[-1].size
    stand = {b.a + k for b in blocks for k in range(b.size)}
    others = TELLING.intersection(text[max(0, start - 1) : end + 2]).difference(template)
    return 0.0 if others or not stand.issuperset(needed(template)) else len(stand) / len(template), start, end


def competing(checked: list[tuple[str, float, int, int, int]]) -> list[tuple[str, int, int, float]]:
    """(label, start, end, score) of those of (label, score, start, end, words) that stand: where spans overlap the one with most words, then
    the better score. A label that refines another one stands beside it."""
    kept: list[tuple[str, int, int, float]] = []
    for label, score, start, end, _ in sorted((c for c in checked if c[1] >= PROOF), key=lambda c: (-round(c[1] * c[4]), -c[1], c)):
        rival = any(start < b and a < end and REFINES.get(label) != k and REFINES.get(k) != label for k, a, b, _ in kept)
        if not rival:
            kept.append((label, start, end, score))
    return sorted(kept)


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (array of phrase, start), found (array of label, start, end, score): one row per document."""
    spark = docs.sparkSession
    d = common.texts(docs)
    # the first element stands for the document, so that one without hits keeps its row and words are read once
    rows = word_grams(d).select("doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "grams")).alias("i", "key"))
    start = F.col("i") - 1 - F.when(F.col("k") == 2, 0).otherwise(F.greatest(F.col("n_words") - 1, F.lit(0))) - F.col("at")
    hits = (
        rows.join(F.broadcast(template_grams(spark)), "key", "left")
        .where("i = 0 or phrase is not null")
        .groupBy("doc_id", "phrase", start.alias("diagonal"))
        .agg(F.collect_set("at").alias("at"), F.max("n_words").alias("n"))
        .groupBy("doc_id")
        .agg(F.max("n").alias("n_words"), F.collect_list(F.when(F.col("phrase").isNotNull(), F.struct("phrase", "diagonal", "at"))).alias("votes"))
    )
    table = templates()

    def vote(frames):
        for f in frames:
            both = [_candidates(v, table) for v in f["votes"]]
            f["base"] = [[{"phrase": p, "start": s} for p, s in b] for b, _ in both]
            f["spans"] = [[{"phrase": p, "low": a, "high": b} for p, a, b in c] for _, c in both]
            yield f[["doc_id", "n_words", "base", "spans"]]

    voted = common.cut(hits.mapInPandas(vote, "doc_id long, n_words long, base array<struct<phrase:int,start:long>>, spans array<struct<phrase:int,low:long,high:long>>"))
    some = voted.where(F.size("spans") > 0).select("doc_id", "spans")

    def verify(frames):
        for f in frames:
            out = []
            for text, spans in zip(f["text"], f["spans"]):
                ws = words(text or "")
                checked = [(table[x["phrase"]][0], *aligned(table[x["phrase"]][1], ws, x["low"], x["high"]), len(table[x["phrase"]][1])) for x in spans]
                out.append([dict(zip(("label", "start", "end", "score"), x)) for x in competing(checked)])
            yield f[["doc_id"]].assign(found=out)

    texts = d.join(common.small(some.select("doc_id")), "doc_id", "left_semi")
    found = texts.join(some, "doc_id").mapInPandas(verify, "doc_id long, found array<struct<label:string,start:long,end:long,score:double>>")
    return voted.select("doc_id", "n_words", "base").join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<label:string,start:long,end:long,score:double>>")))


def query(spark, sf_dir):
    out = licenses(common.documents(spark, sf_dir))
    names = F.create_map(*[F.lit(x) for i, (label, _, base, _) in enumerate(templates()) if base for x in (i, label)])
    base_labels = F.array_distinct(F.transform("base", lambda b: names[b["phrase"]]))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"),
        F.array_max(F.col("base.start")).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("found.score")), F.lit(0.0))).alias("score"),
    )
