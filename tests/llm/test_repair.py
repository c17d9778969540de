"""Conversation repair: the search against an exhaustive one, and whole rows against plain Python."""

import functools
import hashlib
import random
import zlib

from carbonhaul.llm import repair

CONVERSATIONS = "conv_id long, turn long, role string, text string, letter string, audit int"
LETTERS = "suaSUA.:bd"


def exhaustive(letters):
    """Least (cost, audit) over all edits, from the last row backwards."""

    @functools.cache
    def best(i, last, inserted):
        found = [(0, "")] if i == len(letters) and last in (repair.NOTHING, repair.ASSISTANT) else []
        if inserted < 2:
            rest = best(i, repair.FOLLOWS[last], inserted + 1)
            found += [(rest[0] + 3, "I" + rest[1])] if rest else []
        if i < len(letters):
            for letter, cost, then in repair.edges(letters[i], last):
                rest = best(i + 1, then, 0)
                found += [(rest[0] + cost, letter + rest[1])] if rest else []
        return min(found) if found else None

    return best(0, repair.NOTHING, 0)


def test_two_heaps_find_the_least_audit():
    rng = random.Random(5)
    for _ in range(2000):
        letters = "".join(rng.choices(LETTERS, k=rng.randrange(14)))
        assert repair.search(letters)[:2] == exhaustive(letters), letters


def test_stretches_change_nothing():
    rng = random.Random(6)
    for stretch in (1, 2, 7, 40):
        for _ in range(40):
            letters = "".join(rng.choices(LETTERS, k=rng.randrange(65, 120)))
            assert repair.repaired(letters, stretch) == repair.search(letters)[:2]


def plain(rows):
    """All columns of the operator, one conversation after the other."""
    harmed, conversations = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        text = "" if fate == 1 else text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
        role = "user" if fate == 4 else role
        harmed.setdefault(conv, []).extend([(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    out = []
    for conv in conversations:
        order = sorted(
            harmed.get(conv, []),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()),
        )
        seen, letters = set(), ""
        for _, role, text in order:
            inner = text.rstrip(repair.BLANK)
            initial = role[:1] if role[:1] and role[:1] in "sua" else "."
            letters += (
                "b" if not inner else "d" if (role, text) in seen
                else initial if inner[-1] in ".!?" else {".": ":"}.get(initial, initial.upper())
            )
            seen.add((role, text))
        cost, audit = exhaustive(letters) if len(letters) < 200 else repair.search(letters)[:2]
        lines, rest, last = [], iter(order), repair.NOTHING
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rest)[1:]
            if letter == "D":
                continue
            last = repair.SYSTEM if letter == "K" and role[0] == "s" else repair.FOLLOWS[last]
            lines.append(f"{role if letter == 'K' else repair.ROLE[last]}:{text}")
        turns = [t for t, _, _ in order if t is not None]
        pairs = zip(order, order[1:])
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            letters.count("b"), letters.count("d"), sum(map(letters.count, "SUA:")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def test_whole_rows(spark):
    rng = random.Random(7)
    texts = ["Yes.", "no", "", "  \n", "What?", "So it is!  ", "Ünd.", "a\nb", None, "x" * 50_000 + "."]
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", None, "use"]
    rows = [
        (conv, turn, rng.choice(roles), rng.choice(texts))
        for conv in range(60) for turn in rng.sample(range(12), rng.randrange(1, 9))
    ]
    rows += [(None, 1, "user", "Hello."), (None, None, "user", "Hello."), (70, None, "system", "Be."),
             (71, 3, "user", "Tie."), (71, 3, "assistant", "Tie."), (71, 3, "user", "Tie."), (71, 9, None, "End.")]
    # one conversation with most of the rows, over several stretches
    rows += [(99, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(9000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)
    damaged = repair.damaged(df)
    found = repair.staged(repair.summaries(damaged), "test-audits")
    got = repair.with_hashes(damaged, found)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    listed = repair.repaired_rows(damaged, found).where("conv_id = 99").orderBy("place").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in listed)
    assert hashlib.sha256(text.encode()).hexdigest() == got.where("conv_id = 99").first().repaired_sha256
    assert [r.place for r in listed] == list(range(len(listed)))


def test_empty_table(spark):
    rows = repair.damaged(spark.createDataFrame([], CONVERSATIONS))
    assert repair.with_hashes(rows, repair.summaries(rows)).count() == 0
