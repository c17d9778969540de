"""Licence scan by ordered signature rules.

Each licence has hand-written signatures: its tag, its address, the sentence that grants it, its
title, and phrases of its text. A rule is tried only where its keyword stands in the text; keywords
of all rules are found in one pass of an automaton. Of overlapping detections the one of higher
priority stays, then the longer one; what lies inside the interval of one that stays is dropped.
The score is the confidence of the best detection that stays.

Beside the rules' own labels there are base phrases, which count wherever their words follow each
other. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Defined cases: a null or empty text has no words, labels or detections; repeated rows are scanned
each for itself; detections of equal priority, length and place are ordered by label; an empty
table gives no rows; other columns are ignored. Texts are read whole; the gaps of rules are runs of
any length of what is neither letter nor digit. A tag counts every identifier of its expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
from pyspark.sql import functions as F

from .common import lowered, schema, table

#: fixed values: phrase and label
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: label, tag, keyword, title (a regular expression), host and path of its address
LICENCES = (
    ("mit", r"mit", "mit", r"(?:the )?mit(?:/x11)? licen[sc]e", r"opensource\.org/licen[sc]es/mit"),
    ("mit-0", r"mit-0", "mit", r"mit no attribution", r"opensource\.org/licen[sc]es/mit-0"),
    ("x11", r"x11", "x11", r"x11 licen[sc]e", r"xfree86\.org/(?:(?!xfree86\.org/)\S)*?licen[sc]e"),
    ("isc", r"isc", "isc", r"(?:the )?isc licen[sc]e", r"opensource\.org/licen[sc]es/isc"),
    ("apache-1.1", r"apache-1\.1", "apache", r"apache software licen[sc]e,? (?:version )?1\.1", r"apache\.org/licen[sc]es/licen[sc]e-1\.1"),
    ("apache-2.0", r"apache-2\.0", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v)?2(?:\.0)?", r"apache\.org/licen[sc]es/licen[sc]e-2\.0"),
    ("bsd-2", r"bsd-2-clause", "bsd", r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e", r"opensource\.org/licen[sc]es/bsd-2-clause"),
    ("bsd-3", r"bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd licen[sc]e", r"opensource\.org/licen[sc]es/bsd-3-clause"),
    ("bsd-4", r"bsd-4-clause", "bsd", r"(?:original|old|4-clause|four-clause) bsd licen[sc]e", r"spdx\.org/licen[sc]es/bsd-4-clause"),
    ("bsd", r"bsd", "bsd", r"(?:the )?bsd(?:-style)? licen[sc]e", r"opensource\.org/licen[sc]es/bsd-licen[sc]e"),
    ("0bsd", r"0bsd", "bsd", r"(?:zero-clause|0-clause) bsd licen[sc]e", r"opensource\.org/licen[sc]es/0bsd"),
    ("gpl-2", r"gpl-2\.0(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?general public licen[sc]e,? (?:version |v)2", r"gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?gpl-2\.0"),
    ("gpl-3", r"gpl-3\.0(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?general public licen[sc]e,? (?:version |v)3", r"gnu\.org/licen[sc]es/gpl-3\.0"),
    ("gpl", r"gpl", "general public", r"gnu general public licen[sc]e", r"gnu\.org/licen[sc]es/gpl\b"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e,? (?:version |v)2(?:\.1)?", r"gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?lgpl-2\.1"),
    ("lgpl-3", r"lgpl-3\.0(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?lesser general public licen[sc]e,? (?:version |v)3", r"gnu\.org/licen[sc]es/lgpl-3\.0"),
    ("lgpl", r"lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", r"gnu\.org/licen[sc]es/lgpl\b"),
    ("agpl-3", r"agpl-3\.0(?:-only|-or-later|\+)?", "affero", r"(?:gnu )?affero general public licen[sc]e(?:,? (?:version |v)3)?", r"gnu\.org/licen[sc]es/agpl"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", "documentation", r"gnu free documentation licen[sc]e", r"gnu\.org/licen[sc]es/fdl"),
    ("mpl-1.1", r"mpl-1\.1", "mozilla", r"mozilla public licen[sc]e,? (?:version |v)?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", r"mpl-2\.0", "mozilla", r"mozilla public licen[sc]e,? (?:version |v)?2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", r"epl-1\.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v)?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"epl-2\.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v ?)?2(?:\.0)?", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl", r"cddl-1\.[01]", "distribution", r"common development and distribution licen[sc]e", r"opensource\.org/licen[sc]es/cddl"),
    ("cpl", r"cpl-1\.0", "common public", r"common public licen[sc]e", r"opensource\.org/licen[sc]es/cpl"),
    ("eupl", r"eupl-1\.[12]", "european", r"european union public licen[sc]e", r"eupl\.eu/1\.[12]"),
    ("artistic", r"artistic-[12]\.0", "artistic", r"(?:the )?artistic licen[sc]e(?: 2\.0)?", r"opensource\.org/licen[sc]es/artistic"),
    ("zlib", r"zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib\.net/zlib_licen[sc]e"),
    ("libpng", r"libpng(?:-2\.0)?", "libpng", r"libpng licen[sc]e", r"libpng\.org/pub/png/src/libpng-licen[sc]e"),
    ("bsl-1.0", r"bsl-1\.0", "boost", r"boost software licen[sc]e", r"boost\.org/licen[sc]e_1_0"),
    ("busl-1.1", r"busl-1\.1", "business source", r"business source licen[sc]e", r"mariadb\.com/bsl11"),
    ("sspl", r"sspl-1\.0", "server side", r"server side public licen[sc]e", r"mongodb\.com/licensing/server-side"),
    ("elastic-2.0", r"elastic-2\.0", "elastic", r"elastic licen[sc]e(?: 2\.0)?", r"elastic\.co/licensing/elastic-licen[sc]e"),
    ("unlicense", r"unlicense", "unlicen", r"(?:the )?unlicen[sc]e", r"unlicense\.org"),
    ("wtfpl", r"wtfpl", "public", r"do what the f\S{2,3} you want to public licen[sc]e", r"wtfpl\.net"),
    ("cc0", r"cc0-1\.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", r"cc-by-[1234]\.0", "commons", r"creative commons attribution(?: [1-4]\.0)?(?: international| unported)?(?: public)? licen[sc]e", r"creativecommons\.org/licen[sc]es/by/"),
    ("cc-by-sa", r"cc-by-sa-[1234]\.0", "commons", r"creative commons attribution-share ?alike", r"creativecommons\.org/licen[sc]es/by-sa/"),
    ("cc-by-nd", r"cc-by-nd-[1234]\.0", "commons", r"creative commons attribution-no ?deriv(?:s|atives)", r"creativecommons\.org/licen[sc]es/by-nd/"),
    ("cc-by-nc", r"cc-by-nc-[1234]\.0", "commons", r"creative commons attribution-non-? ?commercial", r"creativecommons\.org/licen[sc]es/by-nc/"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1234]\.0", "commons", r"creative commons attribution-non-? ?commercial-share ?alike", r"creativecommons\.org/licen[sc]es/by-nc-sa/"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1234]\.0", "commons", r"creative commons attribution-non-? ?commercial-no ?deriv(?:s|atives)", r"creativecommons\.org/licen[sc]es/by-nc-nd/"),
    ("odbl", r"odbl-1\.0", "database", r"open (?:data commons )?open database licen[sc]e", r"opendatacommons\.org/licen[sc]es/odbl"),
    ("odc-by", r"odc-by-1\.0", "commons", r"open data commons attribution licen[sc]e", r"opendatacommons\.org/licen[sc]es/by"),
    ("pddl", r"pddl-1\.0", "dedication", r"public domain dedication and licen[sc]e", r"opendatacommons\.org/licen[sc]es/pddl"),
    ("ofl", r"ofl-1\.[01]", "font", r"(?:sil )?open font licen[sc]e", r"scripts\.sil\.org/ofl"),
    ("openssl", r"openssl", "openssl", r"openssl licen[sc]e", r"openssl\.org/source/licen[sc]e"),
    ("python-2.0", r"(?:python|psf)-2\.0", "python", r"python software foundation licen[sc]e", r"python\.org/(?:(?!python\.org/)\S)*?licen[sc]e"),
    ("php-3.01", r"php-3\.0[01]?", "php", r"(?:the )?php licen[sc]e", r"php\.net/licen[sc]e"),
    ("ruby", r"ruby", "ruby", r"(?:the )?ruby licen[sc]e", r"ruby-lang\.org/(?:(?!ruby-lang\.org/)\S)*?licen[sc]e"),
    ("vim", r"vim", "vim", r"(?:the )?vim licen[sc]e", r"vimdoc\.sourceforge\.net/(?:(?!vimdoc\.sourceforge\.net/)\S)*?licen[sc]e"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql\.org/about/licen[sc]e"),
    ("ncsa", r"ncsa", "ncsa", r"university of illinois/ncsa open source licen[sc]e", r"opensource\.org/licen[sc]es/ncsa"),
    ("ms-pl", r"ms-pl", "microsoft", r"microsoft public licen[sc]e", r"opensource\.org/licen[sc]es/ms-pl"),
    ("ms-rl", r"ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", r"opensource\.org/licen[sc]es/ms-rl"),
    ("osl-3.0", r"osl-3\.0", "open software", r"open software licen[sc]e", r"opensource\.org/licen[sc]es/osl-3\.0"),
    ("afl-3.0", r"afl-3\.0", "academic", r"academic free licen[sc]e", r"opensource\.org/licen[sc]es/afl-3\.0"),
    ("ecl-2.0", r"ecl-2\.0", "educational", r"educational community licen[sc]e", r"opensource\.org/licen[sc]es/ecl-2\.0"),
    ("upl", r"upl-1\.0", "universal permissive", r"universal permissive licen[sc]e", r"oss\.oracle\.com/licen[sc]es/upl"),
    ("ipl", r"ipl-1\.0", "public", r"ibm public licen[sc]e", r"opensource\.org/licen[sc]es/ipl"),
    ("lppl", r"lppl-1\.3c?", "latex", r"latex project public licen[sc]e", r"latex-project\.org/lppl"),
    ("mulan", r"mulanpsl-[12]\.0", "mulan", r"mulan permissive software licen[sc]e", r"coscl\.org\.cn/mulan"),
    ("blueoak", r"blueoak-1\.0\.0", "blue oak", r"blue oak model licen[sc]e", r"blueoakcouncil\.org/licen[sc]e"),
    ("zpl", r"zpl-2\.[01]", "zope", r"zope public licen[sc]e", r"zope\.org/resources/zpl"),
    ("w3c", r"w3c", "w3c", r"w3c software (?:notice|licen[sc]e)", r"w3\.org/consortium/legal"),
    ("beerware", r"beerware", "beer", r"beer-?ware licen[sc]e", r"people\.freebsd\.org/~phk"),
    ("openrail", r"(?:creativeml-)?openrail(?:-m)?", "rail", r"(?:creativeml )?open rail(?:-m|\+\+-m)? licen[sc]e", r"licenses\.ai"),
    ("llama", r"llama[23]?", "llama", r"llama \d(?:\.\d)? community licen[sc]e", r"llama\.meta\.com/licen[sc]e"),
)

#: label, keyword, sentence
SENTENCES = (
    ("mit", "free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "with or without fee", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-3", "endorse", r"neither the name of (?:(?!neither the name).)+? nor the names of (?:its|the) contributors may be used to endorse"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", "free software", r"this program is free software[:;] you can redistribute it and/or modify"),
    ("lgpl", "free software", r"this library is free software[:;] you can redistribute it and/or modify"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("epl-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("zlib", "express or implied", r"this software is provided 'as-is', without any express or implied warranty"),
    ("bsl-1.0", "accompanying", r"distributed under the boost software licen[sc]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("cc0", "waive", r"to the extent possible under law, (?:(?!to the extent).)+? (?:has|have) waived all copyright"),
    ("public-domain", "public domain", r"(?:released (?:in)?to|placed in|dedicated to|is in) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("permission-required", "written permission", r"without (?:the )?(?:prior )?written permission"),
    ("non-commercial", "commercial", r"for non-?commercial (?:use|purposes) only"),
    ("cc", "some rights reserved", r"some rights reserved"),
)

#: order of priority, with the confidence of each kind
TAG, ADDRESS, SENTENCE, GRANT, TITLE = range(5)
CONFIDENCE = (1.0, 0.95, 0.9, 0.9, 0.75)
BASE_CONFIDENCE = 0.6

GAP = r"(?:[\W_]+)"


def _pattern(text):
    return re.compile(r"(?<![0-9a-z])(?:" + text.replace(" ", GAP) + r")(?![0-9a-z])", re.DOTALL)


@lru_cache(maxsize=1)
def rules():
    """(kind, label, keyword, pattern) of every rule, in order of priority."""
    made = []
    for label, tag, keyword, title, address in LICENCES:
        made += [
            (TAG, label, "spdx", _pattern(tag)),
            (ADDRESS, label, re.sub(r"\\", "", address.split("/")[0]), _pattern(address)),
            (GRANT, label, keyword, _pattern(
                r"(?:licen[sc]ed|distributed|released|available|provided|published)"
                rf" under (?:the )?(?:terms of )?(?:the )?{title}")),
            (TITLE, label, keyword, _pattern(title)),
        ]
    made += [(SENTENCE, label, keyword, _pattern(text)) for label, keyword, text in SENTENCES]
    return sorted(made, key=lambda r: r[0])


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    by_keyword = {}
    for i, (_, _, keyword, _) in enumerate(rules()):
        # a keyword of several words is gated by its longest one: gaps between words vary
        by_keyword.setdefault(max(keyword.split(), key=len), []).append(i)
    for keyword, numbers in by_keyword.items():
        found.add_word(keyword, numbers)
    found.make_automaton()
    return found


_IDENTIFIER = r"[0-9a-z](?:[.+-]*+[0-9a-z])*+"
_TAGGED = re.compile(
    rf"(?<![0-9a-z])spdx-licen[sc]e-identifier:[\W_]*+({_IDENTIFIER}"
    rf"(?:[\W_]++(?:or|and|with)[\W_]++{_IDENTIFIER})*+)"
)


def tagged(text):
    """(start, place) of every identifier of the licence expressions behind tags; the first one
    starts with its tag."""
    found = []
    for tag in _TAGGED.finditer(text):
        start = tag.start()
        for one in re.compile(_IDENTIFIER).finditer(text, tag.start(1), tag.end(1)):
            found.append((start if start < tag.start(1) else one.start(), one.start()))
            start = tag.end()
    return found


def detections(text):
    """(start, end, kind, label) of the detections that stay, by place, in lower-cased text."""
    tried = {i for _, numbers in automaton().iter(text) for i in numbers}
    tags = tagged(text) if "spdx" in text else []
    found = []
    for i in tried:
        kind, label, _, pattern = rules()[i]
        if kind != TAG:
            found += [(m.start(), m.end(), kind, label) for m in pattern.finditer(text)]
        elif tags:
            found += [
                (start, m.end(), kind, label)
                for start, place in tags if (m := pattern.match(text, place))
            ]
    return suppressed(found)


def suppressed(found):
    """Drop what lies inside a detection of higher priority, or of the same and greater length.

    By start, and the longer ones first, what could contain a detection comes before it: the furthest end
    so far decides, among its own kind and among the kinds before.
    """
    kept, starts, furthest = [], [], []
    for _, alike in groupby(sorted(found, key=lambda d: (d[2], d[0], -d[1], d[3])), lambda d: d[2]):
        reach, stay = -1, []
        for one in alike:
            before = bisect_right(starts, one[0])
            if max(reach, furthest[before - 1] if before else -1) < one[1]:
                stay.append(one)
            reach = max(reach, one[1])
        kept = sorted(kept + stay)
        starts, furthest = [d[0] for d in kept], list(accumulate((d[1] for d in kept), max))
    return kept


_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_BETWEEN = rb"[^0-9a-z\x80-\xff]+"
_PHRASES = [
    (phrase.split()[-1].encode(), label, re.compile(
        rb"(?<![0-9a-z\x80-\xff])" + _BETWEEN.join(w.encode() for w in phrase.split())
        + rb"(?![0-9a-z\x80-\xff])"))
    for phrase, label in BASE
]


def word_starts(text):
    """Whether a word begins at each byte."""
    inside = _IN_WORD[np.frombuffer(text, "uint8")]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    return starts


def base_places(text, starts):
    """(first word, label) of every place where a base phrase stands."""
    found = [
        (m.start(), label)
        for gate, label, pattern in _PHRASES if gate in text for m in pattern.finditer(text)
    ]
    if not found:
        return found
    before = np.cumsum(starts)
    # a place is the start of a word itself
    return [(int(before[at]) - 1, label) for at, label in found]


SCANNED = (
    "doc_id long, n_words long, base array<struct<word: long, label: string>>, "
    "found array<struct<start: long, end: long, kind: int, label: string>>"
)


def scanned(docs):
    """doc_id, n_words, base places and detections (character spans) of every row."""

    def scan(batches):
        import pyarrow as pa

        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        found_type = pa.list_(pa.struct([
            ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("label", pa.string())
        ]))
        for batch in batches:
            sizes, bases, found = [], [], []
            for text in batch.column(1).to_pylist():
                raw = lowered(text)
                starts = word_starts(raw)
                sizes.append(int(np.count_nonzero(starts)))
                bases.append([{"word": w, "label": x} for w, x in base_places(raw, starts)])
                found.append([
                    {"start": a, "end": b, "kind": k, "label": x}
                    for a, b, k, x in detections(raw.decode("utf-8", "surrogatepass"))
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(bases, base_type),
                 pa.array(found, found_type)],
                names=["doc_id", "n_words", "base", "found"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, schema(SCANNED))


def digest(rows):
    """Labels, places and score of ``scanned`` rows."""
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    labels = F.array_sort(F.array_union(F.col("base.label"), F.col("found.label")))
    confidence = F.transform(
        "found", lambda d: F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), d["kind"] + 1)
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.word")).alias("first_word"),
        F.array_max(F.col("base.word")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(confidence), F.lit(0.0)),
            F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)),
        ).alias("score"),
    )


def op5_license_scan(spark, sf_dir):
    """Licence phrases and detections of every document."""
    return digest(scanned(table(spark, sf_dir, "documents")))
