"""The hash tree against a plain one, and bitmaps against sorting."""

import hashlib
import zlib

import numpy as np

from carbonhaul.llm import manifest
from carbonhaul.llm.common import lowered, text_session

from .cases import DOCUMENTS, documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[1]
    if lower and text is not None:
        text = lowered(text).decode()
    fields = (row[0], row[3], row[2], row[4], text)
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(nodes):
    """(root, the (left, right) steps of every node)."""
    steps = [[] for _ in nodes]
    under, level = [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        groups = [range(i, min(i + 16, len(level))) for i in range(0, len(level), 16)]
        for group in groups:
            for i in group:
                for own in under[i]:
                    steps[own].append(("".join(level[j] for j in group if j < i), "".join(level[j] for j in group if j > i)))
        level = [h(*[level[i] for i in group]) for group in groups]
        under = [sum((under[i] for i in group), []) for group in groups]
    return (level[0] if level else None), steps


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per_source = []
    for source in sources:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        per_source.append((own, *climb([leaf(r) for r in own])))
    root, tops = climb([subroot for _, subroot, _ in per_source])
    out = []
    for (own, subroot, steps), top in zip(per_source, tops):
        for row, below in zip(own, steps):
            path = below + top
            chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, chosen)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), subroot, root, h(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=str)


def found(df):
    tree = manifest.manifest(df)
    rows = manifest.proofs(tree).select(
        "doc_id", "leaf", "subroot", manifest.F.lit(tree.root).alias("root"),
        manifest.proof_hash(manifest.F.col("path")).alias("proof"),
        manifest.folded(manifest.F.coalesce("tampered", "leaf"), manifest.F.col("path")).alias("folded"),
    )
    return sorted(
        (tuple(r) + (r.folded == r.root,) for r in rows.collect()), key=str
    )


def test_all_cases(spark):
    df = documents(text_session(spark))
    df = df.withColumn("leaf", manifest.F.lit("clash")).withColumn("place", manifest.F.lit(1))
    rows = [tuple(r)[:5] for r in df.collect()]
    # wide gaps, negative ids, one source beyond two levels, repeated ids with other texts
    more = [(i * 1009 - 40_000, f"Text {i}", "en", "many", i) for i in range(700)]
    more += [(70_000, "One", "en", "many", 3), (70_000, "Two", "en", "many", 3), (70_000, "Two", "en", "many", 3),
             (5, "Only", None, "alone", None), (None, "A", "en", "many", 1), (None, "B", "en", "many", 1)]
    both = df.select(*df.columns[:5]).unionByName(spark.createDataFrame(more, DOCUMENTS))
    assert found(both) == plain(rows + more)


def test_single_leaf_and_empty_table(spark):
    one = [(7, "Alone", "en", "s", 5)]
    df = spark.createDataFrame(one, DOCUMENTS)
    assert found(df) == plain(one)
    assert found(df.limit(0)) == []


def test_bitmaps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 4096, 5000, 60_000):
        lows = rng.integers(0, 1 << 16, n)
        merger = manifest.Merger()
        for part in np.array_split(lows, 3):
            values, counts = np.unique(part, return_counts=True)
            merger.add(manifest.Bitmap.unpacked(manifest.Bitmap.of(values, counts).packed()))
        bitmap = manifest.Bitmap.unpacked(merger.result().packed())
        assert bitmap.total == n
        rank, repeated = manifest.Directory(bitmap).rank(lows)
        order = np.sort(lows)
        assert (rank == np.searchsorted(order, lows)).all()
        assert (repeated == (np.searchsorted(order, lows, "right") - np.searchsorted(order, lows) > 1)).all()
