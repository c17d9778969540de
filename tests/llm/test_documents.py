"""Operators on documents: against plain Python, and the defined cases."""

import binascii
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carbonhaul.llm import language_model, licences, mixing, packing, parity_join, sharding, tokens
from carbonhaul.llm import toxicity
from carbonhaul.llm.common import lowered, staged, text_session

from . import cases
from .cases import DOCUMENTS, documents, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    return documents(text_session(spark)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with further columns named like those the operators make."""
    extra = (
        "size length start rank task nth h salt slot shard class keys bucket component_id score "
        "word count row base positive target taken held_out source_key"
    ).split()
    return docs.select("*", *[F.lit("x").alias(c) for c in extra])


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, n, percent):
    """Component of every id, by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y:
                if 100 * len(x & y) >= percent * len(x | y):
                    p, q = find(a), find(b)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
    return sorted(
        ((i, len(s), i if i is None or not s else find(i)) for i, s in sets), key=str
    )


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, clashing, n, percent):
    want = components(rows_of(docs), n, percent)
    for df in (docs, clashing):
        got = parity_join.joined(df, n, percent)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_jaccard_join_of_many_near_copies(spark):
    """A group whose members differ more from each other than from what they were copied from."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = parity_join.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == components(rows, 4, 85)


def test_one_id_with_several_texts_links_through_each(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "other words in this row here")]
    got = parity_join.joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [
        (1, 1), (2, 1), (2, 1), (3, 1), (4, 4)
    ]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 10**6))
def test_linked_sets_share_a_key(size, edits, seed):
    rng = np.random.default_rng(seed)
    one = np.unique(rng.integers(0, 2**64, size, dtype="uint64"))
    other = np.unique(
        np.concatenate([one[edits:], rng.integers(0, 2**64, rng.integers(0, edits + 1), dtype="uint64")])
    )
    common = len(np.intersect1d(one, other))
    if len(other) and 100 * common >= 85 * (len(one) + len(other) - common):
        x, y = (set(parity_join.band_keys(s, 85)[0].tolist()) for s in (one, other))
        assert x & y


def test_keys_are_short_and_no_more_than_may_differ():
    rng = np.random.default_rng(3)
    for size in (1, 20, 410, 480, 555):
        elements = np.unique(rng.integers(0, 2**64, size, dtype="uint64"))
        keys, own = parity_join.band_keys(elements, 85)[:2]
        below = int(parity_join.bands(85)[0][own]) - 1
        each = [(15 * (size + 100 * size // 85)) // 185 + 1]
        if 100 * below // 85 >= size:
            each.append(15 * (size + below) // 185 + 1)
        assert len(keys) == sum(each)
        assert 0 <= keys.min() and keys.max() < 1 << 48


def test_most_sets_have_keys_in_one_band_only():
    rng = np.random.default_rng(7)
    own = below = 0
    for size in range(100, 1000, 7):
        elements = np.unique(rng.integers(0, 2**64, size, dtype="uint64"))
        keys, _, _, bits_below = parity_join.band_keys(elements, 85)
        most = 15 * (size + 100 * size // 85) // 185 + 1
        own, below = own + most, below + max(0, len(keys) - most)
        assert (len(keys) > most) == (len(bits_below) > 0)
    assert 0 < below < own / 2


def test_key_rows_are_small_whatever_the_number_of_partitions(spark):
    """Beside its key, a row has the place of its class in 16 bits and what is equal in all its task."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))) for i in range(40)]
    rows += [(100 + i, text + " more") for i, text in rows[:10]] + [(200 + i, text) for i, text in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sketches = staged(parity_join.sketched(docs, 4, 85), "test-sketches")
    found = parity_join.buckets(sketches)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # dealt once by the key, and the window takes it from there
    assert plan.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(key" not in plan
    of = {r["class"]: r.n_shingles for r in sketches.where("place IS NOT NULL").collect()}
    # copies are one class; ten pairs of near copies
    pairs = {frozenset((r.leader, r["class"])) for r in found.collect()}
    assert len(of) == 50 and len(pairs) == 10 and all(len(p) == 2 for p in pairs)
    assert all(abs(of[a] - of[b]) == 1 for a, b in pairs)
    places = sketches.where("place IS NOT NULL").select("place", F.col("place") % 2**32)
    assert places.distinct().count() == places.count()


def test_sketches_of_different_bands_are_not_compared(spark):
    """Keys of different bands may agree by chance; their sketches have different lengths."""
    rng = np.random.default_rng(11)
    rows, sketches = [], []
    for i, size in enumerate((40, 41, 700, 3000)):
        elements = np.unique(rng.integers(0, 2**64, size, dtype="uint64"))
        if i == 1:
            # the first one with one element more
            elements = np.append(first, np.uint64(2**64 - 5))
        first = elements
        _, band, bits, below = parity_join.band_keys(elements, 85)
        rows.append((1, i, i, len(elements), band, len(below) > 0))
        sketches += [(i, b, s) for b, s in ((band, bits), (band - 1, below)) if s]
    known = spark.createDataFrame(
        rows, "bucket long, class long, part long, size long, band int, below boolean"
    )
    sketches = spark.createDataFrame(sketches, "class long, band int, bits binary")
    for nearest_only in (True, False):
        got = parity_join.within_buckets(parity_join.one_band(known), sketches, 85, nearest_only)
        assert [tuple(r) for r in got.collect()] == [(0, 1)]


def test_members_of_a_leader_are_one_bucket(spark):
    members = spark.createDataFrame(
        [(b, 9, c, 1) for b in (1, 2, 3) for c in (b, 10, 11)], "bucket long, leader long, class long, keys long"
    )
    got = parity_join.gathered(members, members.select("leader", "class").distinct()).collect()
    assert len({r.bucket for r in got}) == 1
    assert sorted(r["class"] for r in got) == [1, 2, 3, 10, 11]


def test_unlike_members_of_a_leader_with_many_keep_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "CHUNK", 4)
    members = spark.createDataFrame(
        [(b, 9, 10 * b + c, 1) for b in (1, 2, 3) for c in range(2)]
        + [(b, 8, 50 + c, 1) for b in (4, 5) for c in range(5)],
        "bucket long, leader long, class long, keys long",
    )
    got = parity_join.gathered(members, members.select("leader", "class").distinct())
    # a leader may have most rows: they are not dealt by it, also where nothing is small
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        assert "BroadcastHashJoin [leader" in got._jdf.queryExecution().executedPlan().toString()
        got = got.collect()
    finally:
        spark.conf.set(threshold, before)
    assert {(r.bucket, r["class"]) for r in got if r["class"] < 50} == {
        (b, 10 * b + c) for b in (1, 2, 3) for c in range(2)
    }
    assert len([r for r in got if r["class"] >= 50]) == 5


def test_packing(docs, clashing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for i, text in rows_of(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, binascii.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    for df in (docs, clashing):
        got = packing.packed(df).toPandas()
        rows = [
            (None if np.isnan(r[0]) else int(r[0]), *map(int, r[1:]))
            for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist()
        ]
        assert Counter(rows) == want
        for _, seq in got.sort_values("offset").groupby("sequence_id"):
            assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
            assert seq.length.sum() <= 2048


def test_packing_takes_one_python_worker_a_task(docs, explain, monkeypatch):
    plans = []
    staged = packing.staged
    monkeypatch.setattr(packing, "staged", lambda df, name: plans.append(explain(df)) or staged(df, name))
    for made in (packing.packed, packing.packed_documents):
        plans.clear()
        made(docs)
        assert plans[0].count("MapInArrow") == 1


def test_packing_keeps_the_ids(docs):
    row = packing.packed_documents(docs.where("doc_id = 0")).first()
    assert len(row.token_ids) == 4 * row.length


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 60), max_size=30))
def test_plan_holds_every_length(histogram):
    runs = packing.plan(histogram, capacity=64, groups=8, rounds=20)
    held = Counter()
    for lengths, n in runs:
        assert sum(lengths) <= 64 and n > 0
        for length in lengths:
            held[length] += n
    assert held == Counter({k: v for k, v in histogram.items() if v})
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in runs) <= 2 * -(-total // 64)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6.3, 1, 20_000).astype(int) + 1)
    values, counts = np.unique(lengths, return_counts=True)
    runs = packing.plan(dict(zip(values.tolist(), counts.tolist())))
    assert sum(n for _, n in runs) <= 1.01 * lengths.sum() / 2048


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\té'\x1f\u200b\u3000.,Ωñ" + "🙂"), max_size=30))
def test_ids_equal_the_tokenizers(text):
    encoder = tokens.encoder("byte_bpe_50k")
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_licences(docs, spark):
    rows = [
        (1, "Under the MIT  License. mit\nlicense"),
        (2, "the GNU General Public License, version 3"),
        (3, "# SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0"),
        (4, "summit license, mit licensed, éapache license"),
        (5, None),
    ]
    got = {r.doc_id: r for r in licences.digest(
        licences.scanned(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert tuple(got[1])[1:7] == (6, 2, 2, 4, "mit", "mit")
    assert (got[2].n_base, got[2].first_word, got[2].labels) == (1, 2, "gpl,gpl-3")
    assert (got[3].labels, got[3].score) == ("apache,apache-2.0", 1.0)
    assert (got[4].n_base, got[4].first_word, got[4].base_labels) == (0, None, "")
    assert (got[5].n_words, got[5].labels, got[5].score) == (0, "", 0.0)
    assert licences.digest(licences.scanned(docs)).count() == docs.count()


def labels_of(text):
    return sorted({d[3] for d in licences.detections(text.lower())})


def test_licence_gaps_of_any_length():
    words = "redistribution and use in source and binary forms, with or without modification"
    for gap in (" " * 41, "\n" + " " * 500 + "* ", "\n% ", '"\n"', "\n! ", "\u00a0", " ) ("):
        assert labels_of(words.replace(" ", gap)) == ["bsd"], repr(gap)
    holder = "The Regents of " + "a very long name " * 20
    assert labels_of(
        f"Neither the name of {holder} nor the names of its contributors may be used to endorse"
    ) == ["bsd-3"]
    assert labels_of(f"To the extent possible under law, {holder} has waived all copyright") == ["cc0"]
    for title in ("- v 2.0", "-v2", "v2.0", "version 2.0", "2.0", ", v 2"):
        assert labels_of(f"Eclipse Public License {title}") == ["epl-2.0"], title


def test_licence_tags_hold_whole_expressions():
    tag = "SPDX-License-Identifier:"
    for expression, expected in (
        (" MIT", ["mit"]),
        ("Apache-2.0", ["apache-2.0"]),
        (" MIT OR Apache-2.0", ["apache-2.0", "mit"]),
        (" (MIT OR Apache-2.0)", ["apache-2.0", "mit"]),
        (" (MIT-0 OR (GPL-2.0-only WITH Classpath-exception-2.0)) AND Zlib",
         ["gpl-2", "mit-0", "zlib"]),
        (" MIT\n# Copyright by Apache-2.0 people", ["mit"]),
        (" unknown", []),
    ):
        assert labels_of(f"// {tag}{expression}\n") == expected, expression
    # time grows with the text, not with its square
    long = f"{tag} mit{'-' * 200_000} eclipse public license{'-' * 200_000}"
    assert labels_of(long + "neither the name of x " * 5_000) == ["mit"]


def test_licence_base_against_words(docs):
    import re

    got = {}
    for r in licences.digest(licences.scanned(docs)).collect():
        got.setdefault(r.doc_id, r)
    for i, text in rows_of(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(
            {c: c + 32 for c in range(65, 91)}))
        places = [
            k for phrase, _ in licences.BASE for k in range(len(w))
            if w[k : k + len(phrase.split())] == phrase.split()
        ]
        assert (got[i].n_words, got[i].n_base) == (len(w), len(places))
        assert (got[i].first_word, got[i].last_word) == (
            (min(places), max(places)) if places else (None, None))


def test_suppression():
    inside, outside = (5, 9, licences.TITLE, "a"), (0, 20, licences.GRANT, "b")
    crossing, longer = (15, 30, licences.TITLE, "c"), (0, 40, licences.TITLE, "d")
    assert licences.suppressed([inside, outside, crossing]) == [outside, crossing]
    assert licences.suppressed([crossing, longer]) == [longer]
    assert len(licences.rules()) >= 200


def plainly_suppressed(found):
    kept = []
    for one in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], d[3])):
        if not any(k[0] <= one[0] and one[1] <= k[1] for k in kept):
            kept.append(one)
    return sorted(kept)


def test_suppression_against_all_pairs_and_in_linear_time():
    import random
    import time

    rng = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(30)):
            start = rng.randrange(20)
            found.append((start, start + rng.randrange(8), rng.randrange(4), rng.choice("abc")))
        assert licences.suppressed(found) == plainly_suppressed(found)
    many = [(7 * i, 7 * i + 9, i % 4, "x") for i in range(16_000)]
    started = time.perf_counter()
    licences.suppressed(many)
    assert time.perf_counter() - started < 1


def test_licence_addresses_of_any_length():
    for site in ("xfree86.org", "python.org", "ruby-lang.org", "vimdoc.sourceforge.net"):
        far = f"see http://www.{site}/{'a/' * 40}license.txt"
        assert {d[3] for d in licences.detections(far)} == {d[3] for d in licences.detections(f"{site}/license")} != set()
        assert not licences.detections(f"{site}/about license")


def test_keyword_gate_loses_nothing(spark):
    """Every rule on every text, without the automaton."""
    texts = [lowered(t).decode() for t in [*cases.texts(), *(r.text for r in spark.read.parquet(
        "/root/testdata/sf0.01/documents.parquet").select("text").collect())] if t]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining a copy".lower(),
              "licensed under the apache license, version 2.0", "spdx-license-identifier: (mit or gpl-2.0+)",
              "# released under the bsd 3-clause license\n# see python.org/psf/license"]
    for text in texts:
        found, tags = [], licences.tagged(text)
        for kind, label, _, pattern in licences.rules():
            if kind != licences.TAG:
                found += [(m.start(), m.end(), kind, label) for m in pattern.finditer(text)]
            else:
                found += [(a, m.end(), kind, label) for a, at in tags if (m := pattern.match(text, at))]
        assert licences.detections(text) == plainly_suppressed(found)


def test_likelihoods(docs, clashing):
    rows = rows_of(docs)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    words = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter()
    for w, out in zip(words, held):
        if not out:
            counts.update([*w, "end"])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), out, len(w) + 1, sum(counts[x] > 0 for x in [*w, "end"]), total,
         round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in [*w, "end"]), 6))
        for (i, _), w, out in zip(rows, words, held)
    )
    for df, hot in ((docs, 5), (clashing, 200_000)):
        got = language_model.likelihoods(df, hot=hot).collect()
        assert sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lattice_sums_all_segmentations():
    lattice = language_model.Lattice({}, 10, language_model.VOCABULARY)
    lattice.pieces = {"▁": -1.0, "a": -2.0, "▁a": -2.5, "aa": -3.0, "▁aa": -4.0}
    lattice.bytes = [-9.0] * 256

    def brute(text):
        if not text:
            return 1.0
        total = 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in lattice.pieces:
                total += math.exp(lattice.pieces[text[:k]]) * brute(text[k:])
        raw = text[0].encode()
        return total + math.exp(sum(lattice.bytes[b] for b in raw)) * brute(text[1:])

    for word in ("a", "aaa", "ab", "é"):
        assert math.isclose(10 ** lattice.word(word.encode()), brute("▁" + word), rel_tol=1e-9)


def test_toxicity(spark):
    import random

    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bcdfghjkl" for b in ("andon", "ellir", "osten", "urvat", "imple")]
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.15
        text = rng.choices(vocabulary, k=rng.randint(10, 40))
        if toxic:
            text += rng.choices(["vileone", "grubber", "wretchly"], k=3)
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (5, None, None)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    truth = {i: any(x in t for x in ("vileone", "grubber", "wretchly")) for i, t in rows}
    wrong = [i for i in truth if (scores[i] >= 0.5) != truth[i]]
    assert len(wrong) <= 20
    assert 0 <= scores[900] < 0.5 and scores[900] == scores[901]
    none = labels.where("toxic = 0")
    assert toxicity.fit(docs, none) is None
    assert toxicity.scored(docs, None).select("score").distinct().collect()[0][0] == 0.0
    assert toxicity.without_toxic(docs, none).count() == docs.count()


def test_risk_and_its_gradient():
    rng = np.random.default_rng(8)
    seen = set()
    for case in range(40):
        width, prior = 6, 0.3
        toxic = (rng.integers(0, 2, (9, width)).astype("float64"), rng.integers(1, 4, 9).astype("float64"))
        other = (rng.integers(0, 2, (12, width)).astype("float64"), rng.integers(1, 4, 12).astype("float64"))
        w = rng.normal(size=width + 1) * 2
        # rows with a weight are rows that often
        value, step = toxicity.risk(w, toxic, other, prior)
        p = [1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) for x, n in zip(*toxic) for _ in range(int(n))]
        u = [1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) for x, n in zip(*other) for _ in range(int(n))]
        clean = np.mean(u) - prior * np.mean(p)
        assert np.isclose(value, prior * (1 - np.mean(p)) + max(0, clean))
        seen.add(clean >= 0)

        def part(v):
            whole, _ = toxicity.risk(v, toxic, other, prior)
            missed = prior * (1 - np.average(toxicity.sigmoid(toxic[0] @ v[:-1] + v[-1]), weights=toxic[1]))
            inner = np.average(toxicity.sigmoid(other[0] @ v[:-1] + v[-1]), weights=other[1])
            back = prior * np.average(toxicity.sigmoid(toxic[0] @ v[:-1] + v[-1]), weights=toxic[1]) - inner
            # where the clean risk is negative the step is that of its opposite
            return whole if clean >= 0 else back if missed >= 0 else None

        for i in range(width + 1):
            move = np.zeros(width + 1)
            move[i] = 1e-6
            slope = (part(w + move) - part(w - move)) / 2e-6
            assert np.isclose(slope, step[i], atol=1e-5)
    assert seen == {True, False}


def test_toxicity_with_one_row_repeated_and_clashing_columns(spark):
    rows = [(i, f"plain words number{i % 7} here", "x", 0.5) for i in range(300)]
    rows += [(1000 + i, "grubber vileone wretchly again", "x", 0.5) for i in range(60)]
    rows += [(1, "one row that is a third of all", "x", 0.5)] * 200
    rows += [(2, "long " * 60_000, "x", 0.5), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, positive string, score double")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 1, 1) for i in range(60)],
        "doc_id long, quality int, toxic int",
    )
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model)
    assert got.columns == ["doc_id", "score"] and got.count() == len(rows)
    assert got.where("doc_id = 1").count() == 201
    assert got.where("doc_id >= 1000 AND score < 0.5").isEmpty()
    assert got.where("doc_id < 1000 AND score >= 0.5").isEmpty()
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 60


def test_mixing_defined_cases(docs, clashing):
    for df in (docs, clashing):
        got = mixing.mixed(mixing.measured(df)).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6 for r in got)
    kept = mixing.repeated(docs)
    assert kept.columns == docs.columns and kept.subtract(docs).isEmpty()


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(2000)]
    got = mixing.mixed(mixing.measured(
        spark.createDataFrame(rows, "doc_id long, text string, source string")))
    by_source = got.groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 7 for r in by_source)
    assert sorted(got.collect()) == sorted(got.collect())


def test_shard_table():
    owner = sharding.lookup_table([f"s{i}" for i in range(10)], 1009)
    counts = Counter(owner)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table([f"s{i}" for i in range(9)], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 9)
    assert moved < 0.1 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_shards_are_written_whole(docs, clashing, tmp_path):
    placed = sharding.place(clashing, "doc_id")
    assert placed.count() == docs.count()
    assert placed.where("shard = 'x' OR slot IS NULL").isEmpty()
    sharding.write_shards(docs, str(tmp_path / "shards"), "doc_id")
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (
        packing.packed(empty),
        parity_join.joined(empty),
        licences.digest(licences.scanned(empty)),
        language_model.likelihoods(empty),
        toxicity.scored(empty, toxicity.fit(empty, labels)),
        mixing.mixed(mixing.measured(empty)),
        mixing.repeated(empty),
        sharding.place(empty, "doc_id"),
    ):
        assert got.count() == 0
