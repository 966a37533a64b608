"""License scans with a positional index of rare licence words.

The index maps every word of the licence templates to its postings (template, position). Document frequencies of these
words are counted over the whole corpus. Every template has its own looked-up words, those of highest inverse document
frequency that hold more than twice the places which may be missing at coverage COVER; each occurrence at position p
and posting at position q vote for the template to start at p - q. Words put in or left out shift what follows, so the
votes of DRIFT + 1 neighbouring starts count together. A stretch with that coverage lacks no more votes than places may
be missing, so none is passed over, whatever else the file holds. Where its votes allow it a template is aligned: the
longest row of its words that stand in order, each within DRIFT places, gives the coverage as a share of the template. It
counts if that reaches COVER and the template's mandatory phrases stand inside the stretch that the row spans. Fixed base
phrases are found apart, at all their places.

Cases: a null text is empty, has no words, no labels and score 0. Ties go to the lower start and the template listed
first. Repeated rows give repeated results, an empty table none. Texts without any template word cost one look.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.shared import byte_table, chunked, kept, read, split_words, strings, translated

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z in lower case: digits, letters and all bytes of longer code points.
WORDS = byte_table(lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
COVER, DRIFT = 0.75, 8
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: (label, mandatory phrases, words): notices as they stand in file heads, and whole texts of short licences. Fixed values.
TEMPLATES = (
    ("gpl", ("gnu general public license",), "this work is licensed under the gnu general public license version 3"),
    ("gpl", ("gnu general public license", "free software foundation"), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", ("gnu lesser general public license",), "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", ("gnu affero general public license",), "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0"),
    ("apache", ("you may not use this file except in compliance with the license",), "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", ("redistribution and use in source and binary forms",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", ("permission to use copy modify",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
    ("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    ("cc-by", ("cc by 4 0",), "licensed under cc by 4 0"),
    ("cc-by", ("creative commons attribution",), "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", ("cc0 1 0",), "cc0 1 0 universal public domain dedication"),
    ("unlicense", ("free and unencumbered software",), "this is free and unencumbered software released into the public domain"),
    ("mit", ("permission is hereby granted free of charge",), """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in
all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an
action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("isc", ("permission to use copy modify",), """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("bsd", ("redistribution and use in source and binary forms",), """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must
reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("zlib", ("altered source versions must be plainly marked",), """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it
freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in
a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented
as being the original software 3 this notice may not be removed or altered from any source distribution"""),
    ("unlicense", ("free and unencumbered software",), """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
)


@dataclass(frozen=True)
class Postings:
    """Of word w, those from first[w] on, size[w] of them: template and position."""

    first: np.ndarray
    size: np.ndarray
    template: np.ndarray
    position: np.ndarray
    least: list[int]


class Index:
    def __init__(self, templates=TEMPLATES, base=BASE):
        phrases = [p for _, ps, _ in templates for p in ps] + [p for p, _ in base]
        self.words = sorted({w for _, _, t in templates for w in t.split()} | {w for p in phrases for w in p.split()})
        number = {w: i for i, w in enumerate(self.words)}
        self.number, self.vocabulary = number, pa.array(self.words, pa.large_string())
        self.templates = [(label, [np.array([number[w] for w in p.split()]) for p in ps], np.array([number[w] for w in t.split()])) for label, ps, t in templates]
        self.base = [(np.array([number[w] for w in p.split()]), label) for p, label in base]

    def postings(self, idf: np.ndarray) -> Postings:
        """The looked-up words' postings, and the votes that each template needs."""
        found: dict[int, list[tuple[int, int]]] = {}
        least = []
        for t, (_, _, words) in enumerate(self.templates):
            spare, n = int(len(words) * (1 - COVER)), 0
            distinct = np.unique(words)
            for w in distinct[np.argsort(-idf[distinct], kind="stable")].tolist():
                if n > 2 * spare:
                    break
                at = np.flatnonzero(words == w).tolist()
                found.setdefault(w, []).extend((t, q) for q in at)
                n += len(at)
            least.append(n - spare)
        size = np.zeros(len(self.words) + 1, np.int64)  # the last is for words outside the index
        for w, own in found.items():
            size[w] = len(own)
        flat = np.array([x for w in sorted(found) for x in found[w]], np.int64).reshape(-1, 2)
        return Postings(np.cumsum(size) - size, size, flat[:, 0], flat[:, 1], least)

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word of texts, -1 for words outside the templates, and words a text."""
        words, counts = split_words(translated(texts, WORDS))
        coded = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        return known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32), counts


def places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.flatnonzero(words[:n] == phrase[0])
    for k in range(1, len(phrase)):
        ok = ok[words[ok + k] == phrase[k]]
    return ok


def chain(words: np.ndarray, template: np.ndarray, start: int) -> list[int]:
    """Places of the longest row of words that stand in the order of the template, each 0 to DRIFT behind start plus its
    own position; of several such rows the one whose last word comes first."""
    low, high = max(0, start), min(len(words), start + len(template) + DRIFT)
    where: dict[int, list[int]] = {}
    for q, w in enumerate(template.tolist()):
        where.setdefault(w, []).append(q)
    ends: list[int] = []  # the least position in the template that ends a row of each length
    last: list[tuple[int, int]] = []  # the (place, entry before) of that row's end
    kept: list[tuple[int, int]] = []
    for p, w in enumerate(words[low:high].tolist(), low):
        for q in reversed(where.get(w, ())):
            if 0 <= p - q - start <= DRIFT:
                k = bisect_left(ends, q)
                kept.append((p, last[k - 1][1] if k else -1))
                if k == len(ends):
                    ends.append(q)
                    last.append((p, len(kept) - 1))
                else:
                    ends[k], last[k] = q, (p, len(kept) - 1)
    out, at = [], last[-1][1] if last else -1
    while at >= 0:
        out.append(kept[at][0])
        at = kept[at][1]
    return out[::-1]


def aligned(index: Index, words: np.ndarray, postings: Postings) -> list[tuple[str, int, float]]:
    """(label, start, coverage) of every template that counts in a text, at its best stretch; words: numbers, -1 for others."""
    n = postings.size[words]
    at = np.flatnonzero(n)
    n = n[at]
    which = np.repeat(postings.first[words[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    templates, starts = postings.template[which], np.repeat(at, n) - postings.position[which]
    out = []
    for t in np.unique(templates).tolist():
        label, phrases, template = index.templates[t]
        own = np.sort(starts[templates == t])
        votes = np.searchsorted(own, own + DRIFT, side="right") - np.arange(len(own))
        best = (0.0, 0)
        for start in np.unique(own[votes >= postings.least[t]]).tolist():
            row = chain(words, template, start)
            cover = len(row) / len(template)
            if cover >= COVER and (cover, -row[0]) > best and all(len(places(words[row[0] : row[-1] + 1], p)) for p in phrases):
                best = (cover, -row[0])
        if best[0]:
            out.append((label, -best[1], best[0]))
    return out


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many texts hold each of the index's words, and the number of texts. A number a word leaves each task."""
    docs = docs.select(F.col(text).alias("__text"))

    def run(batches):
        index, total, n = Index(), None, 0
        total = np.zeros(len(index.words), np.int64)
        for table in chunked(batches, 16 << 20):
            words, counts = index.numbered(strings(table["__text"]))
            at = np.flatnonzero(words >= 0)
            owner = np.searchsorted(np.cumsum(counts), at, side="right")
            total += np.bincount(np.unique(owner * len(index.words) + words[at]) % len(index.words), minlength=len(index.words))
            n += len(counts)
        yield pa.RecordBatch.from_pydict({"word": np.append(np.arange(len(index.words)), -1), "n": np.append(total, n)})

    found = {r.word: r.n for r in docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(i, 0) for i in range(len(Index().words))]), found.get(-1, 0)


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep and n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    df, n = document_frequencies(docs, text)
    idf = np.log((n + 1) / (df + 1))
    keep = kept(keep, ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"))
    docs = docs.select(*keep, F.col(text).alias("__text"))
    fields = docs.select(*keep).schema.fields
    match = pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())])
    more = T._parse_datatype_string("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,coverage:double>>").fields

    def run(batches):
        index = Index()
        postings = index.postings(idf)
        for table in chunked(batches, 16 << 20):
            words, counts = index.numbered(strings(table["__text"]))
            ends = np.cumsum(counts)
            # Every base or mandatory phrase holds its rarest word, so texts without any of these can't match.
            anchors = np.isin(words, np.unique([w[np.argmax(idf[w])] for _, ps, _ in index.templates for w in ps] + [w[np.argmax(idf[w])] for w, _ in index.base]))
            hit = np.zeros(len(counts), bool)
            hit[np.searchsorted(ends, np.flatnonzero(anchors), side="right")] = True
            rows = {c: [] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
            for h, e, size in zip(hit.tolist(), ends.tolist(), counts.tolist()):
                own = words[e - size : e]
                found = [(label, places(own, phrase)) for phrase, label in index.base] if h else []
                where = np.concatenate([p for _, p in found]) if found else np.zeros(0, np.int64)
                base = {label for label, p in found if len(p)}
                more = aligned(index, own, postings) if h else []
                rows["n_base"].append(len(where))
                rows["first_word"].append(int(where.min()) if len(where) else None)
                rows["last_word"].append(int(where.max()) if len(where) else None)
                rows["base_labels"].append(",".join(sorted(base)))
                rows["labels"].append(",".join(sorted(base | {m[0] for m in more})))
                rows["score"].append(max([0.5 if base else 0.0, *(m[2] for m in more)]))
                rows["matches"].append([{"label": a, "start": b, "coverage": c} for a, b, c in more])
            kinds = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(match)}
            yield from pa.table({c: table[c] for c in keep} | {"n_words": counts} | {c: pa.array(v, kinds[c]) for c, v in rows.items()}).to_batches()

    return docs.mapInArrow(run, T.StructType([*fields, *more]))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), ["doc_id"]).drop("matches")
