"""N-gram Jaccard join by parity sketches.

Every distinct word n-gram is a 64-bit hash. Sets of n and m elements with Jaccard similarity of at
least t differ in at most ``d = (1 - t) / (1 + t) * (n + m)`` elements, and m lies between t * n and
n / t. Documents are put into size bands that each span ``RATIOS`` times that ratio, so that only the
smallest of a band, which may be the larger partner of one below, are sketched for that one too. A
band's sketch has ``blocks`` words; an n-gram's hash chooses one and is XORed into it. One element that only one of two sets holds changes
one word, so the number of words in which two sketches differ never exceeds the number of elements
in which the sets differ: two linked sketches agree in at least ``blocks - d`` words.

Agreeing words are found by a join on (band, word's place, word). Words of few elements agree by
chance, so every sketch leaves out its ``blocks - d - 1`` lightest words, in the order of (number of
elements, value, place). This loses nothing: of the words in which two linked sketches agree, the
last in that order has at least ``blocks - d - 1`` others below it on both sides, so neither leaves
it out. This holds for each document by itself: ``d`` words may differ from its largest partner in the
band, which are fewer for its smaller members, and it leaves out ``blocks - d - 1`` by its own ``d``. So
``d + 1`` keys per document and band remain. A key has 48 bits: among a billion, some thousands of
pairs agree by chance, also across bands, which cost a comparison each. A key is sent with the number
of its class in its task, in one word, and the task's number, which is equal from row to row.

Rows with equal sets are one class from then on. In each bucket of equal keys the class of the
smallest place leads. Every class is compared with the leader that it shares most keys with, components follow, and
then with those of its other leaders that are still in different components. Members of one leader, or of one
bucket where these are many, that are in different components after that are held against each other by bit sketches, in blocks within a task:
there an n-gram flips one bit, the Hamming distance is again a lower bound, and pairs whose distance
exceeds ``d`` go no further. First each member is compared with its nearest one in another component;
then, with the components that follow, all pairs that the sketches leave. So thousands of near
copies cost a few comparisons each and not all pairs, and no link between components is missed.
Comparisons are exact: they count the n-grams of both texts.

Defined cases: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words than an
n-gram has is one element as a whole; a text without words, or null, has no element and links with
nothing; rows that share a doc_id are one document, which links through each of its texts; a null
doc_id links with nothing and has no component; an empty table gives no rows; other columns are
ignored. Texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from .common import discard, lowered, schema, staged, table
from .components import components

NGRAM, PERCENT = 4, 85
#: sketch words beyond those that may differ, as a share of them
SPARE = 4
#: partner ratios that a size band spans
RATIOS = 3
#: bits of a bit sketch, as a multiple of the elements that may differ
BITS = 8
#: members of a bucket that are held against as many others at a time
CHUNK = 1024
#: partners that one copy of a document's text is compared with
COMPARED = 256
#: bits of a hash that a join key leaves out, where the lower bits of a place go
PLACE_BITS = 16
KEY_SHIFT = np.uint64(PLACE_BITS)
#: words whose hashes a task keeps
KEPT_WORDS = 60_000
#: ids that are sent to every executor as they are; more of them are joined by shuffle
SMALL_IDS = 500_000

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype="uint64",
)


def mixed(x):
    x = (x ^ (x >> _MIX[2])) * _MIX[0]
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[2])


class Shingles:
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n):
        import xxhash

        if not 1 <= n <= len(_PLACES):
            raise ValueError(f"n-grams of 1 to {len(_PLACES)} words")
        self.n, self.hash, self.known = n, xxhash.xxh3_64_intdigest, {}

    def of(self, text):
        words = lowered(text).split()
        if not words:
            return np.empty(0, "uint64")
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = set(words)
        known.update((w, self.hash(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, words), dtype="uint64", count=len(words))
        if len(words) < self.n:
            short = np.uint64(len(words))
            for i in range(len(words)):
                short = short + h[i : i + 1] * _PLACES[i]
            return mixed(short ^ _PLACES[-1])
        count = len(words) - self.n + 1
        total = h[:count] * _PLACES[0]
        for i in range(1, self.n):
            total = total + h[i : i + count] * _PLACES[i]
        return np.unique(mixed(total))


@lru_cache(maxsize=8)
def bands(percent):
    """Start of every size band, and (largest partner, differing elements) of each."""
    starts, spans = [1], []
    while starts[-1] < 1 << 32:
        start = starts[-1]
        for _ in range(RATIOS):
            start = 100 * start // percent + 1
        starts.append(start)
    for after in starts[1:]:
        largest = after - 1
        partner = 100 * largest // percent
        spans.append((partner, (100 - percent) * (largest + partner) // (100 + percent)))
    return np.array(starts), spans


def own_band(size, percent):
    return int(np.searchsorted(bands(percent)[0], size, "right")) - 1


def may_differ(size, largest, percent):
    """Elements in which a set and a linked one of at most ``largest`` elements may differ."""
    partner = min(100 * size // percent, largest)
    return (100 - percent) * (size + partner) // (100 + percent)


def bit_sketch(elements, d):
    """Parity of the elements per bit."""
    words = -(-BITS * (d + 1) // 64)
    low = elements & np.uint64(0xFFFFFFFF)
    flips = np.bincount(
        ((low * np.uint64(words * 64)) >> np.uint64(32)).astype("int64"), minlength=words * 64
    )
    return np.packbits((flips & 1).astype("uint8")).tobytes()


def band_keys(elements, percent):
    """Join keys of a set, and its bit sketches, in its own band and in the one below, where it
    may be the larger partner (an empty sketch if it is too large for that)."""
    spans = bands(percent)[1]
    own = own_band(len(elements), percent)
    keys, bits = [], []
    for band in (own, own - 1):
        if band < 0 or (band < own and len(elements) > spans[band][0]):
            bits.append(b"")
            continue
        d = spans[band][1]
        bits.append(bit_sketch(elements, d))
        blocks = d + 1 - (-d // SPARE)
        # in its own band it meets larger sets of the next one, below only those of that band
        largest = spans[band][0] if band == own else int(bands(percent)[0][band + 1]) - 1
        spare = blocks - 1 - may_differ(len(elements), largest, percent)
        place = ((elements >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        value = np.bitwise_xor.reduceat(elements, first)
        weight = np.diff(np.append(first, len(elements)))
        place = place[first]
        empty = blocks - len(place)
        if empty < spare:
            kept = np.lexsort((place, value, weight))[spare - empty :]
            value, place = value[kept], place[kept]
        elif empty > spare:
            none = np.setdiff1d(np.arange(blocks, dtype="uint64"), place)[spare:]
            value = np.concatenate((value, np.zeros(len(none), "uint64")))
            place = np.concatenate((place, none))
        key = mixed(value ^ mixed((np.uint64(band) << np.uint64(32)) + place + np.uint64(1)))
        keys.append(key >> KEY_SHIFT)
    return np.concatenate(keys).view("int64"), own, *bits


SKETCHED = (
    "doc_id long, n_shingles long, class long, class2 long, place long, keys array<long>, "
    "band int, bits binary, bits_below binary"
)


def sketched(docs, ngram, percent):
    """Size, class (128 bits of the whole set), join keys and bit sketches of every document.

    A task gives the keys of a class once, so that a group of copies adds a few rows per task. Their
    place is the task's number and, in the lower 32 bits, that of the class in the task.
    """

    def sketch(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        # of this task: a worker process that goes on to other work holds nothing
        of, seen, nothing = Shingles(ngram).of, set(), (None, [], None, None, None)
        types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elements = of(text)
                digest = xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else bytes(16)
                made = nothing
                if len(elements) and doc is not None and digest not in seen:
                    made = first + len(seen), *band_keys(elements, percent)
                    seen.add(digest)
                rows.append((len(elements), *np.frombuffer(digest, "int64").tolist(), *made))
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=[
                    "doc_id", "n_shingles", "class", "class2", "place", "keys", "band", "bits",
                    "bits_below",
                ],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sketch, schema(SKETCHED)
    )


def buckets(sketches):
    """(bucket, leader, class, keys): classes that share keys with one of a smaller place, which leads,
    and their number. Buckets of the same places are one.
    """
    from pyspark.sql import Window

    key = F.shiftrightunsigned("word", PLACE_BITS)
    low = F.lit((1 << PLACE_BITS) - 1)
    rows = sketches.select("place", F.explode("keys").alias("key")).select(
        F.shiftleft("key", PLACE_BITS).bitwiseOR(F.col("place").bitwiseAND(low)).alias("word"),
        F.shiftright("place", PLACE_BITS).alias("high"),
    )
    rows = rows.repartition(key).select(
        key.alias("key"),
        F.shiftleft("high", PLACE_BITS).bitwiseOR(F.col("word").bitwiseAND(low)).alias("place"),
    )
    same = Window.partitionBy("key")
    rows = rows.select(
        "place",
        F.min("place").over(same).alias("first"),
        F.count(F.lit(1)).over(same).alias("n"),
        F.bit_xor(F.xxhash64("place", F.lit(1))).over(same).alias("x"),
        F.sum(F.shiftright(F.xxhash64("place"), 32)).over(same).alias("s"),
    )
    shared = (
        rows.where("place <> first")
        .groupBy(F.xxhash64("first", "n", "x", "s").alias("bucket"), "first", "place")
        .agg(F.count(F.lit(1)).alias("keys"))
    )
    named = sketches.where("place IS NOT NULL").select("place", "class")
    leaders = named.select(F.col("place").alias("first"), F.col("class").alias("leader"))
    # a class that several tasks met has several places
    return (
        shared.join(named, "place").join(leaders, "first").where("class <> leader")
        .groupBy("bucket", "leader", "class").agg(F.max("keys").alias("keys"))
    )


def links(pairs, docs, ngram, percent):
    """Those of ``pairs`` (a, b) whose texts are similar enough.

    Texts are read once. The text of b goes to a's, which is sent once for every ``COMPARED`` of its
    partners, so that a document with many of them is compared in many tasks.
    """
    if pairs.isEmpty():
        return pairs
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / COMPARED).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b"
    )
    ends = staged(
        dealt.select(F.col("b").alias("node"), "a", "share", "b").unionByName(
            dealt.select(F.col("a").alias("node"), "a", "share", F.lit(None).cast("long").alias("b"))
            .distinct()
        ),
        "join-ends",
    )
    named = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    met = named.join(F.broadcast(ends) if ends.count() <= SMALL_IDS else ends, "node")

    def compare(batches):
        import pyarrow as pa

        of, group, led = Shingles(ngram).of, None, []
        for batch in batches:
            linked = []
            for a, share, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, share) != group:
                    group, led = (a, share), []
                elements = of(text)
                if b is None:
                    # a document that stands in several rows links through each of its texts
                    if not any(np.array_equal(elements, x) for x in led):
                        led.append(elements)
                    linked.append(False)
                else:
                    linked.append(any(similar(x, elements, percent) for x in led))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(linked, pa.bool_()))

    ordered = (
        met.select("a", "share", "b", "text").repartition("a", "share")
        .sortWithinPartitions("a", "share", F.col("b").isNotNull())
    )
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def similar(one, other, percent):
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(other) - common) > 0


def gathered(members, led):
    """(bucket, class): all members of a leader as one bucket, where these are few or fewer pairs than
    those of its buckets, which share most of their members."""
    size = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    squares = members.groupBy("leader", "bucket").agg(F.count(F.lit(1)).alias("m"))
    squares = squares.groupBy("leader").agg(F.sum(F.col("m") * F.col("m")).alias("squares"))
    # leaders of more than a chunk each, so few beside their members
    split = size.join(squares, "leader").where(
        (F.col("n") > CHUNK) & (F.col("n") * F.col("n") > F.col("squares"))
    ).select("leader", F.lit(True).alias("split"))
    bucket = F.when(F.col("split"), F.col("bucket")).otherwise(F.xxhash64("leader"))
    return members.join(F.broadcast(split), "leader", "left").select(
        bucket.alias("bucket"), "class"
    ).distinct()


def one_band(known):
    """Members (bucket, class, part, size, band) whose band is that of the sketch to be compared, the
    same in a bucket, from such with their own band and whether they have a sketch ``below`` it.

    Where members have no sketch of the lowest band among them, as keys agree by chance or a leader has
    keys in two bands, the bucket is parted by band, with both sketches of each member.
    """
    span = known.groupBy("bucket").agg(
        F.min("band").alias("lowest"),
        F.max(F.col("band") - F.col("below").cast("int")).alias("common"),
    )
    shared = F.col("common") <= F.col("lowest")
    each = F.when(shared, F.array("lowest")).when(
        F.col("below"), F.array(F.col("band"), F.col("band") - 1)
    ).otherwise(F.array("band"))
    return known.join(span, "bucket").withColumn("at", F.explode(each)).select(
        F.when(shared, F.col("bucket")).otherwise(F.xxhash64("bucket", "at")).alias("bucket"),
        "class", "part", "size", F.col("at").alias("band"),
    )


def within_buckets(rows, sketches, percent, nearest_only):
    """Pairs (leader, class) of ``rows`` (bucket, class, part, size, band) in different components
    whose bit ``sketches`` (class, band, bits) allow a link; or each member's nearest of them. A bucket's
    band is one. Sketches are sent once, to the groups.

    Large buckets are cut into chunks; every pair of chunks is one group.
    """
    chunks = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = rows.join(chunks, "bucket").withColumn(
        "chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
    )
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        "chunk", "class", "part", "size", "band",
    ).join(sketches, ["class", "band"])

    def hold(group):
        import pyarrow as pa

        ids, parts, sizes = (group.column(c).to_numpy() for c in ("class", "part", "size"))
        chunk = group.column("chunk").to_numpy()
        one, other = (group.column(c)[0].as_py() for c in ("i", "j"))
        x, y = np.flatnonzero(chunk == one), np.flatnonzero(chunk == other)
        bits = group.column("bits").to_pylist()
        bits = np.frombuffer(b"".join(bits), "uint64").reshape(len(bits), -1)
        found = []
        step = max(1, (1 << 21) // max(1, len(y) * bits.shape[1]))
        for start in range(0, len(x), step):
            some = x[start : start + step, None]
            total = sizes[some] + sizes[y]
            far = np.bitwise_count(bits[some] ^ bits[y]).sum(axis=2, dtype="int64")
            able = (parts[some] != parts[y]) & ((100 + percent) * far <= (100 - percent) * total)
            able &= 100 * np.minimum(sizes[some], sizes[y]) >= percent * np.maximum(sizes[some], sizes[y])
            if one == other:
                able &= True if nearest_only else some < y
            if nearest_only:
                far = np.where(able, far, far.max(initial=0) + 1)
                rows_with, columns_with = able.any(axis=1), able.any(axis=0)
                found.append((some[rows_with, 0], y[far.argmin(axis=1)[rows_with]]))
                if one != other:
                    found.append((some[far.argmin(axis=0)[columns_with], 0], y[columns_with]))
            else:
                p, q = np.nonzero(able)
                found.append((some[p, 0], y[q]))
        p = np.concatenate([f[0] for f in found]) if found else np.empty(0, "int64")
        q = np.concatenate([f[1] for f in found]) if found else np.empty(0, "int64")
        return pa.table({"leader": ids[p], "class": ids[q]})

    pairs = dealt.groupBy("bucket", "i", "j").applyInArrow(hold, "leader long, class long")
    return pairs.select(
        F.least("leader", "class").alias("leader"), F.greatest("leader", "class").alias("class")
    ).distinct()


def joined(docs, ngram=NGRAM, percent=PERCENT):
    """doc_id, n_shingles, component_id of every row."""
    sketches = staged(sketched(docs, ngram, percent), "join-sketches")
    facts = staged(sketches.select("doc_id", "n_shingles", "class", "class2"), "join-facts")
    members = staged(buckets(sketches), "join-buckets")
    # bit sketches of the classes that share a key with others; the keys are not needed any more
    bits = staged(
        sketches.where("band IS NOT NULL").join(
            members.select("class").distinct(), "class", "left_semi"
        )
        .groupBy("class")
        .agg(*(F.first(c).alias(c) for c in ("n_shingles", "band", "bits", "bits_below"))),
        "join-bits",
    )
    discard(sketches)
    named = facts.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(
        named.groupBy("class", "class2").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("size")
        ),
        "join-classes",
    )

    def comparable(pairs):
        """Pairs of classes as pairs of documents of fitting size."""
        one = classes.select(
            F.col("class").alias("leader"), F.col("node").alias("a"), F.col("size").alias("size_a")
        )
        other = classes.select("class", F.col("node").alias("b"), F.col("size").alias("size_b"))
        fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
        pairs = pairs.join(one, "leader").join(other, "class").where(fits & (F.col("a") != F.col("b")))
        return staged(pairs.select("a", "b").distinct(), "join-pairs")

    def parts_of(found):
        return classes.join(components(found), "node", "left").select(
            "class", "class2", F.coalesce("component", "node").alias("part")
        )

    # a doc_id with several texts links their classes
    several = named.join(classes, ["class", "class2"]).select("doc_id", "node").distinct()
    several = (
        several.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
        .where("a <> z").drop("z").join(several, "doc_id")
        .select("a", F.col("node").alias("b")).where("a <> b")
    )
    led = staged(members.groupBy("leader", "class").agg(F.sum("keys").alias("keys")), "join-led")
    closest = led.groupBy("class").agg(F.max_by("leader", F.struct("keys", "leader")).alias("leader"))
    found = staged(
        links(comparable(closest), docs, ngram, percent).unionByName(several), "join-links"
    )
    parts = staged(parts_of(found), "join-parts")

    def enlarged(pairs):
        """Links and components with what of ``pairs`` turns out to be linked."""
        more = staged(links(pairs, docs, ngram, percent), "join-more")
        if more.isEmpty():
            return found, parts
        both = staged(found.unionByName(more), "join-links")
        return both, staged(parts_of(both), "join-parts")

    # classes and leaders that are still apart
    one_part = parts.groupBy("class").agg(F.min("part").alias("part"))
    apart = (
        led.join(one_part, "class")
        .join(one_part.select(F.col("class").alias("leader"), F.col("part").alias("leading")), "leader")
        .where("part <> leading").select("leader", "class")
    )
    found, parts = enlarged(comparable(apart))

    groups = staged(gathered(members, led), "join-groups")
    below = F.length("bits_below") > 0
    known = bits.select("class", F.col("n_shingles").alias("size"), "band", below.alias("below"))
    by_band = bits.select("class", "band", "bits").unionByName(
        bits.where(below).select("class", (F.col("band") - 1).alias("band"), F.col("bits_below").alias("bits"))
    )
    # members of one bucket in different components
    for nearest_only in (True, False):
        within = groups.join(parts.groupBy("class").agg(F.min("part").alias("part")), "class")
        unlike = (
            within.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"))
            .where("p <> q").select("bucket")
        )
        still = staged(
            within.join(unlike, "bucket", "left_semi").select("bucket", "class", "part"), "join-open"
        )
        if still.isEmpty():
            break
        rows = one_band(still.join(known, "class"))
        found, parts = enlarged(comparable(within_buckets(rows, by_band, percent, nearest_only)))

    has_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return facts.join(parts, ["class", "class2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(has_class, F.col("part")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op4_jaccard_join(spark, sf_dir):
    """Size and component of every document's set of 4-word shingles, linked from 85 percent."""
    return joined(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s FROM words),
classes AS (
  SELECT min(doc_id) AS node, list_sort(s) AS s FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY list_sort(s)),
grams AS (SELECT node, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node
   AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
  SELECT node, node AS seen FROM classes UNION
  SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a),
parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(x.s) = 0 OR doc_id IS NULL THEN doc_id ELSE p.component END AS component_id
FROM sets x LEFT JOIN classes c ON c.s = list_sort(x.s) LEFT JOIN parts p ON p.node = c.node"""
