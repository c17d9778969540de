"""Repair of conversation structure by a bidirectional search over the edit lattice.

A conversation's rows, in order of turn, are to read ``system? (user assistant)*`` by their roles'
initials. A node of the lattice is (rows done, what was written last); its edges are the edits:

* Keep the next row, free, where its initial is the one that has to follow;
* Rerole the next row to the role that has to follow;
* Delete the next row, required where it is blank or a duplicate;
* Insert an empty row of the role that has to follow.

A truncated row costs extra unless it is deleted. Only one role can follow a node, and a leading
system row can only be kept, so the letters K, R, D, I of an audit fix its path.

Two heaps meet in the lattice: one from the first node, one from both ends. Once the least known
crossing is no more than the sum of both heaps' tops, all nodes that are on cheapest paths are settled
on one side at least. The forward side's are found by walking back from the equal-cost crossings, and
the audit is the path that takes the least letter at every node among those edges that lie on cheapest
paths.

Two shuffles by conversation carry the work. The first has a few dozen bytes a row and no texts: rows
stream through in order, become one letter each, and the search runs on them. Conversations of the same letters
share one search. Long ones are searched in stretches of ``STRETCH`` rows: costs to the end go from stretch
to stretch backwards, then each stretch is searched from where the one before it ended. The
second shuffle brings an audit before its conversation's rows, which stream through the hash of the repaired
text. So a conversation with a third of all rows needs the memory of one byte a row, as its audit
does, and its texts are never held together: the hash of one text has to be read in order by one task.

Defined cases: nulls in ``conv_id``, ``role`` and ``text`` read as one space, in ``turn`` as one space for the
hash and before all numbers in order; a null conv_id is a conversation of its own. Rows of the same
turn go by role and then by the sha256 of their text; repeated rows are duplicates of each other. A
role's initial is its first character; an empty role, like any other initial, fits nowhere. Long
texts are hashed in place. A conversation that lost all rows has zeros, an empty audit and the hash
of nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, schema, staged, table

KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3
#: rows searched at once in a long conversation
STRETCH = 4096
#: characters that are white space here
BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: what was written last: nothing, a system row, a user row, an assistant row
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
INITIAL = {USER: "u", ASSISTANT: "a"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: a conversation may end after nothing or after an assistant row
END_COSTS = (0, None, None, 0)


def damaged(conversations):
    """The rows after damage, with ``copy``; a dropped row stays, with ``copy`` null and no text."""
    blank = F.lit(" ")
    text = F.coalesce("text", blank)
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), blank),
        F.coalesce(F.col("turn").cast("string"), blank),
    )
    fate = F.crc32(key.cast("binary")) % 20
    kept = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fate <= 1, F.lit("")).when(fate == 2, F.translate(text, ENDS, "")).otherwise(text)
        .alias("text"),
        fate.alias("fate"),
    )
    copies = F.when(F.col("fate") == 0, F.array(F.lit(None).cast("int"))).when(
        F.col("fate") == 3, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    return kept.withColumn("copy", F.explode(copies)).drop("fate")


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def marked(rows):
    """conv_id, turn, role, digest, nth, kind and letter of every row, without its text.

    The letter is the row's initial (``.`` where it fits nowhere), in upper case if it is truncated;
    ``b`` for a blank row, ``d`` for a duplicate. ``kind`` is the initial itself.
    """
    inner = F.rtrim("text", F.lit(BLANK))
    narrow = rows.select(
        "conv_id", "turn", "role", "copy", _digest().alias("digest"),
        (inner == "").alias("blank"),
        (~F.substring(inner, -1, 1).isin(*ENDS)).alias("truncated"),
    ).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "role", "digest", F.col("copy").isNull()).orderBy(
        F.col("turn").asc_nulls_first(), "copy"
    )
    kind = F.substring("role", 1, 1)
    initial = F.when(kind.isin("s", "u", "a"), kind).otherwise(".")
    letter = (
        F.when(F.col("copy").isNull(), F.lit(None))
        .when(F.col("blank"), "b")
        .when(F.col("nth") > 1, "d")
        .when(F.col("truncated"), F.when(initial == ".", F.lit(":")).otherwise(F.upper(initial)))
        .otherwise(initial)
    )
    return narrow.withColumn("nth", F.row_number().over(alike)).select(
        "conv_id", "turn", "role", "digest", "nth", kind.alias("kind"), letter.alias("letter")
    )


def edges(letter, last):
    """(letter of the edit, cost, last) of the edits that use the row, from one node."""
    found = [("D", DELETE, last)]
    if letter not in "bd":
        extra = KEEP_TRUNCATED if letter in "SUA:" else 0
        initial, then = letter.lower(), FOLLOWS[last]
        if initial == INITIAL[then]:
            found.append(("K", extra, then))
        elif initial == "s" and last == NOTHING:
            found.append(("K", extra, SYSTEM))
        found.append(("R", REROLE + extra, then))
    return found


#: the edits of every letter and last row, and the same edges backwards
FORWARD = {x: [edges(x, last) for last in range(4)] for x in "sua.SUA:bd"}
BACKWARD = {
    x: [[(cost, last) for last in range(4) for _, cost, then in by_last[last] if then == node]
        for node in range(4)]
    for x, by_last in FORWARD.items()
}
INSERT_BEFORE = [[last for last in range(4) if FOLLOWS[last] == node] for node in range(4)]


def costs_to_end(letters, end_costs, final):
    """Least cost from each of the four first nodes to the end: the reverse heap, to the last node."""
    settled = _Reverse(letters, end_costs, final)
    while settled.heap:
        settled.step()
    return tuple(settled.cost.get(node) for node in range(4))


class _Reverse:
    """The heap from the ends. Nodes are 4 * rows done + last."""

    def __init__(self, letters, end_costs, final):
        self.letters, self.final, self.cost = letters, final, {}
        self.reached, self.heap = {}, []
        for last, cost in enumerate(end_costs):
            if cost is not None:
                self._reach(4 * len(letters) + last, cost)

    def _reach(self, node, cost):
        if node not in self.reached or cost < self.reached[node]:
            self.reached[node] = cost
            heapq.heappush(self.heap, (cost, -node))

    def step(self):
        cost, node = heapq.heappop(self.heap)
        node = -node
        if node in self.cost:
            return None
        self.cost[node] = cost
        done, last = divmod(node, 4)
        if done < len(self.letters) or self.final:
            for before in INSERT_BEFORE[last]:
                self._reach(4 * done + before, cost + INSERT)
        if done:
            for extra, before in BACKWARD[self.letters[done - 1]][last]:
                self._reach(4 * (done - 1) + before, cost + extra)
        return node


class _Forward:
    """The heap from the first node, with the edges that reach a settled node at its cost."""

    def __init__(self, letters, first, final):
        self.letters, self.final, self.cost = letters, final, {}
        self.heap, self.reached = [(0, first)], {first: 0}

    def edges(self, node):
        done, last = divmod(node, 4)
        n = len(self.letters)
        if done < n or self.final:
            yield "I", INSERT, 4 * done + FOLLOWS[last]
        if done < n:
            for letter, cost, then in FORWARD[self.letters[done]][last]:
                yield letter, cost, 4 * (done + 1) + then

    def step(self):
        cost, node = heapq.heappop(self.heap)
        if node in self.cost:
            return None
        self.cost[node] = cost
        for _, extra, then in self.edges(node):
            if then not in self.reached or cost + extra < self.reached[then]:
                self.reached[then] = cost + extra
                heapq.heappush(self.heap, (cost + extra, then))
        return node


def search(letters, first=NOTHING, end_costs=END_COSTS, final=True):
    """(cost, audit, last) of the cheapest edits with the least audit, by two heaps that meet.

    The search ends at a node whose rows are all done, at ``end_costs`` of what was written last. Only
    in the ``final`` stretch rows may be inserted after the last row.
    """
    ahead, behind = _Forward(letters, first, final), _Reverse(letters, end_costs, final)
    best = None
    while ahead.heap and behind.heap:
        if best is not None and ahead.heap[0][0] + behind.heap[0][0] > best:
            break
        if ahead.heap[0][0] <= behind.heap[0][0]:
            node = ahead.step()
        else:
            node = behind.step()
        if node is not None and node in ahead.reached and node in behind.reached:
            cost = ahead.reached[node] + behind.reached[node]
            best = cost if best is None else min(best, cost)
    # all equal-cost crossings: nodes that both sides reached at costs that add up to the least
    to_end = dict(behind.cost)
    open_nodes = [n for n, c in ahead.reached.items() if c + behind.reached.get(n, best + 1) == best]
    to_end.update((n, behind.reached[n]) for n in open_nodes)
    # from the crossings back over the forward side: nodes on cheapest paths and their cost to the end
    before = {}
    for node, cost in ahead.cost.items():
        for _, extra, then in ahead.edges(node):
            if ahead.reached[then] == cost + extra:
                before.setdefault(then, []).append((node, extra))
    while open_nodes:
        node = open_nodes.pop()
        for earlier, extra in before.get(node, ()):
            if earlier not in to_end:
                to_end[earlier] = extra + to_end[node]
                open_nodes.append(earlier)
    # the least letter at every node
    node, left, audit, n = first, best, [], len(letters)
    while not (node >= 4 * n and end_costs[node % 4] == left):
        letter, cost, node = min(
            e for e in ahead.edges(node) if e[2] in to_end and to_end[e[2]] + e[1] == left
        )
        left -= cost
        audit.append(letter)
    return best, "".join(audit), node % 4


@lru_cache(maxsize=200_000)
def _short(letters):
    return search(letters)[:2]


def repaired(letters, stretch=STRETCH):
    """(cost, audit) of a whole conversation's letters."""
    if len(letters) <= 64:
        return _short(letters)
    if len(letters) <= stretch:
        return search(letters)[:2]
    parts = [letters[i : i + stretch] for i in range(0, len(letters), stretch)]
    ends = [END_COSTS]
    for number in range(len(parts) - 1, 0, -1):
        ends.append(costs_to_end(parts[number], ends[-1], number == len(parts) - 1))
    last, audits, cost = NOTHING, [], None
    for number, part in enumerate(parts):
        found, audit, last = search(part, last, ends.pop(), number == len(parts) - 1)
        cost = found if cost is None else cost
        audits.append(audit)
    return cost, "".join(audits)


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string"
)


class _Conversation:
    """What is known of a conversation while its rows pass."""

    LEGAL = {"su", "ua", "au"}

    def __init__(self, conv_id):
        self.conv_id, self.letters = conv_id, bytearray()
        self.first = self.turn = None
        self.turns = self.illegal = 0
        self.kind = None

    def add(self, turn, kind, letter):
        if self.kind is not None and self.kind + kind not in self.LEGAL:
            self.illegal += 1
        self.kind = kind
        self.letters += letter.encode()
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1

    def summary(self):
        letters = self.letters.decode()
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        cost, audit = repaired(letters)
        return (
            self.conv_id, gaps, letters.count("b"), letters.count("d"),
            sum(map(letters.count, "SUA:")), self.illegal, cost, audit,
        )


def _summaries(batches):
    """Ordered rows to one summary a conversation."""
    import pyarrow as pa

    names = [field.split()[0] for field in SUMMARY.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()]

    def out(found):
        columns = list(zip(*found)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    current, found = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "letter")]
        for conv_id, turn, kind, letter in zip(*columns):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    found.append(current.summary())
                current = _Conversation(conv_id)
            if letter is not None:
                current.add(turn, kind, letter)
        if len(found) >= BATCH_ROWS:
            yield out(found)
            found = []
    if current is not None:
        found.append(current.summary())
    yield out(found)


def summaries(rows):
    """Faults, cost and audit of every conversation of ``damaged`` rows."""
    ordered = marked(rows).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "nth"
    )
    return ordered.select("conv_id", "turn", "kind", "letter").mapInArrow(
        _summaries, schema(SUMMARY)
    )


class _Edits:
    """An audit applied to its conversation's rows, one after the other."""

    def __init__(self, conv_id, summary):
        self.conv_id, self.summary, self.audit = conv_id, summary, summary["audit"]
        self.at, self.last = 0, NOTHING

    def inserted(self):
        """The rows inserted here."""
        while self.audit.startswith("I", self.at):
            self.at, self.last = self.at + 1, FOLLOWS[self.last]
            yield ROLE[self.last], ""

    def next_row(self, role, text):
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "K" and role[:1] == "s":
            self.last = SYSTEM
        else:
            self.last = FOLLOWS[self.last]
        yield (ROLE[self.last] if letter == "R" else role), text


def _rebuilt(batches):
    """Summaries, each followed by its conversation's rows, to lists of (edits, role, text), one a
    batch; a conversation's first entry has no text."""
    edits = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "summary", "role", "text")]
        made = []
        for conv_id, summary, role, text in zip(*columns):
            if summary is not None:
                edits = _Edits(conv_id, summary)
                made.append((edits, None, None))
            else:
                made += [(edits, *row) for row in edits.next_row(role, text)]
            made += [(edits, *row) for row in edits.inserted()]
        yield made


def _summaries_before_rows(rows, found):
    """One stream a task: every conversation's summary, then its rows in order."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    summary = F.struct(*[c for c in found.columns if c != "conv_id"]).alias("summary")
    heads = found.select(
        "conv_id", summary, none("long", "turn"), none("string", "role"), none("binary", "digest"),
        none("string", "text"),
    )
    body = rows.where(F.col("copy").isNotNull()).select(
        "conv_id", none(heads.schema["summary"].dataType, "summary"), "turn", "role",
        _digest().alias("digest"), "text",
    )
    return (
        heads.unionByName(body)
        .repartition("conv_id")
        .sortWithinPartitions(
            "conv_id", F.col("summary").isNull(), F.col("turn").asc_nulls_first(), "role", "digest"
        )
        .select("conv_id", "summary", "role", "text")
    )


def repaired_rows(rows, found):
    """conv_id, place, role and text of all rows of the repaired conversations."""

    def listed(batches):
        import pyarrow as pa

        edits, place = None, 0
        for made in _rebuilt(batches):
            out = []
            for owner, role, text in made:
                if owner is not edits:
                    edits, place = owner, 0
                if text is not None:
                    out.append((owner.conv_id, place, role, text))
                    place += 1
            columns = list(zip(*out)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "place", "role", "text"]
            )

    return _summaries_before_rows(rows, found).mapInArrow(
        listed, schema("conv_id long, place long, role string, text string")
    )


def with_hashes(rows, found):
    """``found`` with the sha256 of the repaired conversation: ``role:text`` joined by new lines."""
    out_schema = schema(f"{SUMMARY}, repaired_sha256 string")
    names = list(out_schema.names)

    def hashed(batches):
        import pyarrow as pa

        types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]

        def out(found):
            columns = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names
            )

        def row(edits, digest):
            return (edits.conv_id, *edits.summary.values(), digest.hexdigest())

        edits, digest, empty, done = None, None, True, []
        for made in _rebuilt(batches):
            for owner, role, text in made:
                if owner is not edits:
                    if edits is not None:
                        done.append(row(edits, digest))
                    edits, digest, empty = owner, hashlib.sha256(), True
                if text is not None:
                    line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                    digest.update(line if empty else b"\n" + line)
                    empty = False
            if done:
                yield out(done)
                done = []
        if edits is not None:
            done.append(row(edits, digest))
        yield out(done)

    return _summaries_before_rows(rows, found).mapInArrow(hashed, out_schema)


def op11_conversation_repair(spark, sf_dir):
    """Faults, cheapest repair and hash of the repaired text of every damaged conversation."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    return with_hashes(rows, staged(summaries(rows), "repair-audits"))


def _sql_edit(cost, letter, line, then):
    """An edit in front of what is cheapest from ``then``: struct of cost and audit, and text."""
    return (
        f"CASE WHEN {then}.k = '~' THEN {then} ELSE {{'k': lpad(CAST(CAST({then}.k[1:9] AS INT) + "
        f"{cost} AS VARCHAR), 9, '0') || '{letter}' || {then}.k[10:], 'r': {line} || {then}.r}} END"
    )


def op11_sql():
    """Costs and audits backwards from each conversation's end, one row a step."""
    none, done = "{'k': '~', 'r': ''}", "{'k': '000000000', 'r': ''}"
    delete = {q: _sql_edit(4, "D", "''", q) for q in "nsua"}
    kept = "(role || ':' || text || chr(10))"
    options = {}
    for q, then, role in (("n", "u", "user"), ("s", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user")):
        keep = _sql_edit("extra", "K", kept, then)
        rerole = _sql_edit("3 + extra", "R", f"('{role}:' || text || chr(10))", then)
        system = f"CASE WHEN initial = 's' THEN {_sql_edit('extra', 'K', kept, 's')} ELSE {none} END"
        found = f"{delete[q]}, {rerole}, CASE WHEN initial = '{then}' THEN {keep} ELSE {none} END"
        options[q] = f"{found}, {system}" if q == "n" else found
    by_row = ", ".join(
        f"CASE WHEN fixed THEN {delete[q]} ELSE least({options[q]}) END AS {q}" for q in "nsua"
    )

    def with_inserts(source):
        insert_user = _sql_edit(3, "I", "('user:' || chr(10))", "u")
        insert_assistant = _sql_edit(3, "I", "('assistant:' || chr(10))", "a")
        return f"""
      SELECT conv_id, i, least(n, {insert_user}) AS n, least(s, {insert_user}) AS s, u, a FROM (
        SELECT conv_id, i, n, s, least(u, {insert_assistant}) AS u, least(a, {insert_user}) AS a
        FROM ({source}))"""

    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1
           THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS x(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
fates AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
            list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM keyed, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fates WHERE fate <> 0),
nth AS (
  SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS inner_text,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM harmed),
marked AS (
  SELECT *, role[1:1] AS initial, inner_text = '' OR nth > 1 AS fixed,
         CASE WHEN inner_text[-1:] IN ('.', '!', '?') THEN 0 ELSE 3 END AS extra,
         row_number() OVER o AS i, lag(role[1:1]) OVER o AS earlier
  FROM nth WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth)),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (inner_text = '') AS blank, count(*) FILTER (inner_text <> '' AND nth > 1) AS duplicate,
         count(*) FILTER (NOT fixed AND extra > 0) AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         max(i) AS size FROM marked GROUP BY conv_id),
walk AS (
  {with_inserts(f"SELECT conv_id, size AS i, {done} AS n, {none} AS s, {none} AS u, {done} AS a FROM faults")}
  UNION ALL
  {with_inserts(f'''SELECT w.conv_id, w.i - 1 AS i, {by_row}
        FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i''')})
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(n.k[1:9], '0') AS BIGINT) AS cost, coalesce(n.k[10:], '') AS audit,
       sha256(coalesce(n.r[1:length(n.r) - 1], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 0"""
