"""Licence scan with a positional rare-token index.

The index maps the words of the licence templates to their postings (template, place). A
first pass counts in how many documents each of these words occurs, over the whole
corpus. A template of m words is found where some stretch of the file is within k word edits
(insertions, deletions, replacements) of it, k being 30 % of m. At least m - k of its words then stand
there unchanged, so of its k + 1 rarest places one does: each template keeps postings for these alone.
The scan looks up the words of a file, takes the stretches that the postings point at by their
relative position, for templates with a key phrase in the file, and aligns each stretch with the
template. A template's label is given only if one of its mandatory key phrases stands in the aligned
stretch; this equals aligning every template with the whole file.

The base labels come from the same index: a base phrase is found through its rarest word and
verified word by word at every place.

Defined cases: a null text has no words; a file with no template word has no label and
score 0; repeated rows each get a row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import by_arrow, raw_texts

_SEP = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else (c + 32 if 0x41 <= c <= 0x5A else c) for c in range(256))

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, mandatory key phrases, wording of the notice or licence text.
TEMPLATES = (
    ("mit", ("mit license",), "released under the mit license"),
    (
        "mit",
        ("permission is hereby granted",),
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    (
        "mit",
        ("permission is hereby granted", "the above copyright notice and this permission notice"),
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        ("permission to use copy modify and or distribute this software",),
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    ("apache-2", ("apache license",), "licensed under the apache license version 2 0"),
    (
        "apache-2",
        ("apache license", "except in compliance with the license"),
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial"), "licensed under cc by nc 4 0"),
    ("cc-by-nc", ("creative commons attribution noncommercial",), "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", ("cc by 4", "cc by 3"), "licensed under cc by 4 0"),
    ("cc-by", ("creative commons attribution 4", "creative commons attribution 3"), "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", ("gnu general public license",), "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        ("gnu general public license",),
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will "
        "be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
        "public license for more details",
    ),
    ("lgpl-3", ("gnu lesser general public license",), "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", ("gnu affero general public license",), "licensed under the gnu affero general public license version 3"),
    ("bsd-3", ("bsd license", "3 clause bsd"), "released under the 3 clause bsd license"),
    (
        "bsd-2",
        ("redistribution and use in source and binary forms",),
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution",
    ),
    (
        "bsd-3",
        ("neither the name of",),
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
    ),
    ("mpl-2", ("mozilla public license",), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "unlicense",
        ("released into the public domain",),
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("proprietary", ("all rights reserved",), "all rights reserved"),
)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words; separators are ASCII other than digits and letters."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_SEP).split()


def least_edits(template: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For every end in the words the fewest word edits between the template and a stretch that ends there (Sellers)."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(template, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return row[1:]


class LicenseIndex:
    def __init__(self, df: dict[str, int], n_docs: int, min_share: float = 0.7):
        self.templates = [(label, [k.encode().split() for k in keys], wording.encode().split()) for label, keys, wording in TEMPLATES]
        self.base = [(label, phrase.encode().split()) for phrase, label in BASE.items()]
        self.idf = {w.encode(): math.log((n_docs + 1) / (df.get(w, 0) + 1)) for w in vocabulary()}
        self.number = {w: i for i, w in enumerate(self.idf, 1)}  # 0: any other word
        self.coded = [np.array([self.number[w] for w in words]) for _, _, words in self.templates]
        self.edits = [int((1 - min_share) * len(words) + 1e-9) for _, _, words in self.templates]
        self.postings: list[list[tuple[bytes, int]]] = []
        for t, (_, _, words) in enumerate(self.templates):
            rare = sorted(range(len(words)), key=lambda q: (-self.idf[words[q]], q))[: self.edits[t] + 1]
            self.postings.append([(words[q], q) for q in rare])
        rarest = lambda ws: max(range(len(ws)), key=lambda i: (self.idf[ws[i]], -i))
        self.base_at = [rarest(words) for _, words in self.base]
        self.keys = [[(key, rarest(key)) for key in keys] for _, keys, _ in self.templates]
        # a label needs a key phrase, and a base label its phrase: files with neither rarest word are done at once
        self.triggers = frozenset(words[i] for (_, words), i in zip(self.base, self.base_at)) | frozenset(
            key[rarest(key)] for _, keys, _ in self.templates for key in keys
        )

    @staticmethod
    def _places(words: list[bytes], where: dict[bytes, list[int]], phrase: list[bytes], anchor: int) -> list[int]:
        return [p - anchor for p in where.get(phrase[anchor], ()) if p >= anchor and words[p - anchor : p - anchor + len(phrase)] == phrase]

    def _aligned(self, t: int, where: dict[bytes, list[int]], coded: np.ndarray, keys: list[tuple[int, int]]) -> float | None:
        """The best share of the template in a stretch with a key phrase, or None if no stretch is within the edits."""
        m, k = len(self.coded[t]), self.edits[t]
        spans = sorted((max(0, p - q - k), min(len(coded), p - q + m + k)) for w, q in self.postings[t] for p in where.get(w, ()))
        best = None
        lo = hi = 0
        for a, b in [*spans, (len(coded) + 1, 0)]:
            if a <= hi and hi:
                hi = max(hi, b)
                continue
            if hi:
                ends = least_edits(self.coded[t], coded[lo:hi])
                for e in np.flatnonzero(ends <= k).tolist():
                    end = lo + e + 1
                    if any(s >= end - m - k and s + n <= end for s, n in keys):
                        best = max(best or 0.0, 1 - ends[e] / m)
            lo, hi = a, b
        return best

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, score: the best aligned share, or the share of a base phrase in its shortest template."""
        present = set(words)
        if present.isdisjoint(self.triggers):
            return [], set(), set(), 0.0
        where: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.number:
                where[w].append(i)
        starts, base, score = [], set(), 0.0
        for (label, phrase), anchor in zip(self.base, self.base_at):
            if found := self._places(words, where, phrase, anchor):
                starts += found
                base.add(label)
                score = max(score, min(1.0, len(phrase) / min(len(ws) for n, _, ws in self.templates if n == label)))
        labels, coded = set(base), None
        for t, (label, _, _) in enumerate(self.templates):
            keys = [(s, len(key)) for key, anchor in self.keys[t] for s in self._places(words, where, key, anchor)]
            if keys:
                if coded is None:
                    coded = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
                share = self._aligned(t, where, coded, keys)
                if share is not None:
                    labels.add(label)
                    score = max(score, share)
        return starts, base, labels, score


def vocabulary() -> list[str]:
    words = {w for _, _, wording in TEMPLATES for w in wording.split()} | {w for p in BASE for w in p.split()}
    return sorted(words | {w for _, keys, _ in TEMPLATES for k in keys for w in k.split()})


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, and the number of documents."""
    vocab = frozenset(w.encode() for w in vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        n = 0
        for b in batches:
            n += b.num_rows
            for raw in raw_texts(b.column("text")):
                for w in vocab.intersection(words_of(raw)):
                    seen[w] += 1
        rows = [(w.decode(), c) for w, c in sorted(seen.items())] + [("", n)]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows]), "df": pa.array([c for _, c in rows], pa.int64())})

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, df long")
    got = {r["word"]: r["df"] for r in parts.groupBy("word").agg(F.sum("df").alias("df")).collect()}  # one row a template word
    return got, got.pop("", 0)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    df, n = document_frequency(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        index = LicenseIndex(df, n)

        def work(batch: pa.RecordBatch) -> dict:
            out = []
            for raw in raw_texts(batch.column("text")):
                words = words_of(raw)
                starts, base, labels, score = index.scan(words)
                ends = (min(starts), max(starts)) if starts else (None, None)
                out.append((len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
            return {"doc_id": batch.column("doc_id")} | {c: pa.array(v, kind) for c, kind, v in zip(names, kinds, zip(*out))}

        return work

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return by_arrow(rows, schema, make)
