"""License scans: ordered signature rules behind a keyword prefilter.

Method
------
Each license has names (regular expressions over lower-cased text), an identifier and, where it
has wording of its own, sentences of its body. Names and identifiers written into sentence and tag
patterns give some hundreds of generated rules with a priority and a confidence by kind: identifier
tags first, grants and body sentences next, then references and bare names. The sentence patterns
decide score and suppression; the label comes from the name. Runs of white space, and comment marks
at the start of lines, count as one space. A keyword automaton runs over the whole text first, and only rules whose keyword occurs are
tried. Detections are then taken by priority, length and place; one that lies inside a
detection already taken is suppressed, so "license mit" inside "released under the mit
license" counts once.

Base phrases are found beside that as runs of consecutive words, with their word numbers.

Edge cases
----------
Null text is empty: no words, no labels, score 0. Null ids and repeated rows are scanned like
any other. An empty table gives an empty table. Texts are scanned whole, one at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from trailsift.llm.common import lower_ascii, row_blocks, string_bytes

# Label, keyword that every name holds, name patterns (lower case).
NAMES = (
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?2(?:\.0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.1"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit", "mit", r"(?:mit|expat) licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause) bsd|bsd[ -]2[ -]clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd|bsd[ -]3[ -]clause"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4-clause) bsd|bsd[ -]4[ -]clause"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[cs]e"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)1(?:\.0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e,? (?:version |v)3(?:\.0)?"),
    ("gpl-2.0", "gpl", r"(?<![al])gpl ?v?-?2(?:\.0)?"),
    ("gpl-3.0", "gpl", r"(?<![al])gpl ?v?-?3(?:\.0)?"),
    ("lgpl-2.1", "general public", r"(?:lesser|library) general public licen[cs]e,? (?:version |v)2(?:\.[01])?"),
    ("lgpl-3.0", "general public", r"lesser general public licen[cs]e,? (?:version |v)3(?:\.0)?"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("lgpl", "lgpl", r"lgpl(?: ?v?-?[23](?:\.[01])?)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v)3(?:\.0)?)?"),
    ("agpl-3.0", "agpl", r"agpl(?: ?v?-?3(?:\.0)?)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?2(?:\.0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,? (?:- )?(?:version |v)?1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e,? (?:- )?(?:version |v)?2\.0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("eupl", "european union public", r"european union public licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e,? (?:version |v)?2\.0"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("boost", "boost", r"boost software licen[cs]e"),
    ("python-2.0", "python", r"python software foundation licen[cs]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e"),
    ("odbl", "open database", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?"),
    ("cc0", "public domain dedication", r"public domain dedication"),
    ("public-domain", "public domain", r"public domain"),
    ("cc-by-nc-nd", "cc by", r"cc by-nc-nd(?: [1-4]\.0)?"),
    ("cc-by-nc-sa", "cc by", r"cc by-nc-sa(?: [1-4]\.0)?"),
    ("cc-by-nc", "cc by", r"cc by-nc(?![-a-z])(?: [1-4]\.0)?"),
    ("cc-by-nd", "cc by", r"cc by-nd(?: [1-4]\.0)?"),
    ("cc-by-sa", "cc by", r"cc by-sa(?: [1-4]\.0)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution[- ]non-?commercial[- ]share-?alike"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non-?commercial"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[- ]no-?deriv(?:ative)?s"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share-?alike"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("creative-commons", "creative commons", r"creative commons licen[cs]e"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[cs]e)"),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d|copyright \(c\)"),
)
#: Identifiers as tags write them, with their labels.
IDENTIFIERS = ("apache-2.0", "apache-1.1", "mit", "mit-0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "gpl-1.0",
               "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "gfdl", "mpl-1.1", "mpl-2.0", "epl-1.0",
               "epl-2.0", "cddl", "eupl", "artistic-2.0", "isc", "zlib", "unlicense", "wtfpl", "odbl", "odc-by",
               "ms-pl", "cc0", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd")
#: Sentences of the licenses' own texts (lower case, single spaces), with their labels.
BODIES = (
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl-1.0", "either version 1, or (at your option) any later version"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation; either version 2"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation, either version 3"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation; either version 2.1"),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software foundation, either version 3"),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation, either version 3"),
    ("gfdl", "permission is granted to copy, distribute and/or modify this document under the terms of the gnu free "
             "documentation license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1.1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("epl-1.0", "the accompanying materials are made available under the terms of the eclipse public license v1.0"),
    ("epl-2.0", "the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("zlib", "this software is provided 'as-is', without any express or implied warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("boost", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
              "software and accompanying documentation"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("ofl", "this font software is licensed under the sil open font license"),
)
BODY_PRIORITY, BODY_CONFIDENCE = 4, 0.95
#: Sentence patterns around a name: priority, confidence, text before, text after.
KINDS = (
    (4, 0.95, r"(?:licensed|released|distributed|published|available|provided)"
              r"(?: to you)? (?:under|according to|in accordance with)(?: the)?(?: terms of(?: the)?)? ", ""),
    (3, 0.9, r"(?:subject to|governed by|covered by|under)(?: the)?(?: terms of(?: the)?)? ", ""),
    (3, 0.85, r"licen[cs]e(?: ?:| is| -)(?: the)? ", ""),
    (2, 0.7, r"(?:see|read)(?: the)? ", ""),
    (1, 0.5, "", ""),
)
#: Phrases of words that stand consecutively, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.4


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    confidence: float
    pattern: str


def rules() -> list[Rule]:
    """All rules: every name in every sentence, body sentences, and every identifier in two tag forms."""
    out = [Rule(label, keyword, priority, confidence, rf"(?<![a-z0-9]){before}(?:{name}){after}(?![a-z0-9])")
           for label, keyword, name in NAMES for priority, confidence, before, after in KINDS]
    out += [Rule(label, body, BODY_PRIORITY, BODY_CONFIDENCE, rf"(?<![a-z0-9]){re.escape(body)}(?![a-z0-9])")
            for label, body in BODIES]
    for label in IDENTIFIERS:
        spelled = re.escape(label)
        out.append(Rule(label, "spdx", 5, 1.0, rf"spdx-license-identifier: ?{spelled}(?:-only|-or-later|-[1-4]\.0)?"
                                               rf"(?![a-z0-9.-])"))
        out.append(Rule(label, "license", 5, 0.9, rf"license[\"']?[ =:]{{1,3}}[\"']{spelled}(?:-[1-4]\.0)?[\"']"))
    return out


#: White space that is no single space, with the comment marks at the start of the next line.
_RUNS = re.compile(r"[ \t\r\f\v\xa0]*\n(?:\s|(?:/{2,}|/?\*+|#+|;+|%+|--+|>+)(?=\s))*|[ \t\r\f\v\xa0]{2,}|[\t\r\f\v\xa0]")


def one_line(text: str) -> str:
    """The text as the rules read it: places keep their order, so what lies inside what does not change."""
    return _RUNS.sub(" ", text)


class Scanner:
    """Compiled rules and the automaton over their keywords; one per Python worker."""

    def __init__(self):
        self.rules = rules()
        self.compiled: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by_keyword.setdefault(rule.keyword, []).append(i)
        for keyword, found in by_keyword.items():
            self.automaton.add_word(keyword, found)
        self.automaton.make_automaton()

    def detect(self, text: str) -> list[tuple[int, int, Rule]]:
        """Detections (start, end, rule) in lower-cased text that no other one suppresses; places are
        those of ``one_line(text)``."""
        text = one_line(text)
        wanted: dict[int, list[int]] = {}
        for _, found in self.automaton.iter(text):
            wanted[id(found)] = found
        every = []
        for found in wanted.values():
            for i in found:
                if i not in self.compiled:
                    self.compiled[i] = re.compile(self.rules[i].pattern)
                every.extend((m.start(), m.end(), i) for m in self.compiled[i].finditer(text))
        every.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[0], d[2]))
        # Largest end of a taken detection that starts at or before a place: a Fenwick tree of maxima.
        starts = sorted({d[0] for d in every})
        tree = [-1] * (len(starts) + 1)
        taken = []
        for start, end, i in every:
            at = k = bisect_right(starts, start)
            reach = -1
            while k > 0:
                reach, k = max(reach, tree[k]), k & (k - 1)
            if reach >= end:
                continue
            taken.append((start, end, self.rules[i]))
            while at < len(tree):
                tree[at], at = max(tree[at], end), at + (at & -at)
        return taken


_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_INSIDE = rb"[0-9a-z\x80-\xff]"


class BasePhrases:
    """Places of phrases of consecutive words in lower-cased bytes."""

    def __init__(self, phrases: Mapping[str, str]):
        self.phrases = []
        for phrase, label in phrases.items():
            words = [w.encode() for w in phrase.split()]
            rarest = max(words, key=len)
            pattern = rb"(?<!" + _INSIDE + rb")(?=" + _GAP.join(map(re.escape, words)) + rb"(?!" + _INSIDE + rb"))"
            self.phrases.append((rarest, re.compile(pattern + re.escape(words[0])), label))

    def find(self, data: bytes) -> list[tuple[int, str]]:
        out = []
        for rarest, pattern, label in self.phrases:
            if rarest in data:
                out.extend((m.start(), label) for m in pattern.finditer(data))
        return out


_scanner: list[Scanner] = []


def _scan(phrases: Mapping[str, str]):
    outside = np.ones(256, bool)
    outside[48:58] = outside[97:123] = outside[128:] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        scanner, base = _scanner[0], BasePhrases(phrases)
        for batch in batches:
            data, offsets = string_bytes(batch.column("__text"))
            for a, b in row_blocks(offsets, 1 << 20):
                low = lower_ascii(data[offsets[a]:offsets[b]])
                at = offsets[a:b + 1] - offsets[a]
                inside = ~outside[low]
                start = inside.copy()
                start[1:] &= ~inside[:-1]
                first = at[:-1][at[:-1] < at[1:]]
                start[first] = inside[first]
                starts = np.flatnonzero(start)
                bounds = np.searchsorted(starts, at)
                whole = low.tobytes()
                rows = []
                for i in range(b - a):
                    text = whole[at[i]:at[i + 1]]
                    places = base.find(text)
                    numbers = np.searchsorted(starts[bounds[i]:bounds[i + 1]], [p + at[i] for p, _ in places])
                    found = scanner.detect(text.decode("utf-8", "replace"))
                    base_labels = sorted({label for _, label in places})
                    labels = sorted({*base_labels, *(r.label for _, _, r in found)})
                    score = max([0.0, *(r.confidence for _, _, r in found), *([BASE_CONFIDENCE] if places else [])])
                    rows.append((int(bounds[i + 1] - bounds[i]), len(places),
                                 int(numbers.min()) if places else None, int(numbers.max()) if places else None,
                                 ",".join(base_labels), ",".join(labels), score))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["__id", *_RESULT])
    return run


_RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: Mapping[str, str] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per document."""
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kinds = [LongType()] * 4 + [StringType()] * 2 + [DoubleType()]
    schema = StructType([slim.schema["__id"], *(StructField(n, k) for n, k in zip(_RESULT, kinds))])
    return slim.mapInArrow(_scan(dict(BASE_PHRASES if phrases is None else phrases)), schema).withColumnRenamed(
        "__id", id_col)
