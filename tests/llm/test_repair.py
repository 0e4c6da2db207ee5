"""Repairs of conversations against a dynamic program over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomwork.llm import repair

BLANK = re.compile(r"[^\x20\x09-\x0D]")
ROLES = {"user": "u", "assistant": "a"}
ACCEPTED = re.compile(r"(s?(ua)+)?")


def best(rows: list[tuple[str, str, str]]) -> tuple[int, str, str]:
    """Cost, audit and text by a forward program; rows are (role, text, fault or empty)."""
    follow = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}

    def inserted(states):
        for _ in range(3):
            for last, (cost, audit, lines) in list(states.items()):
                for role, initial in ROLES.items():
                    if initial in follow[last]:
                        new = (cost + 5, audit + "I", [*lines, role + ":"])
                        states[initial] = min(states.get(initial, new), new, key=lambda s: s[:2])
        return states

    states = {"": (0, "", [])}
    for role, text, fault in rows:
        new: dict = {}
        for last, (cost, audit, lines) in inserted(states).items():
            options = [("D", 2, last, None)]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in follow[last]:
                    options.append(("K", extra, role[:1], role))
                options += [("R", 1 + extra, i, r) for r, i in ROLES.items() if i in follow[last]]
            for letter, price, then, name in options:
                got = (cost + price, audit + letter, lines + ([f"{name}:{text}"] if name else []))
                new[then] = min(new.get(then, got), got, key=lambda s: s[:2])
        states = new
    final = [s for last, s in inserted(states).items() if last in ("", "a")]
    cost, audit, lines = min(final, key=lambda s: s[:2])
    return cost, audit, "\n".join(lines)


def faults_of(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for row in rows:
        shown = row[1].rstrip(" \t\n\x0b\x0c\r")
        out.append(
            "blank" if not BLANK.search(row[1]) else "duplicate" if row in seen
            else "truncated" if shown[-1] not in ".!?" else ""
        )
        seen.add(row)
    return out


def plain(rows: list[tuple]) -> set[tuple]:
    out, damaged = set(), {}
    for conv, turn, role, text in rows:
        damaged.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        damaged[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    for conv, found in damaged.items():
        def content(row):
            return hashlib.sha256("".join(f"{len(x)}:{x}" for x in row[1:]).encode()).hexdigest()

        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], content(r)))
        shown = [r[1:] for r in found]
        kinds = faults_of(shown)
        turns = {r[0] for r in found if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(shown))
        cost, audit, text = best([(*s, k) for s, k in zip(shown, kinds, strict=True)])
        out.add(
            (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
             hashlib.sha256(text.encode()).hexdigest())
        )
    return out


COLUMNS = (
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
)
KIND = "conv_id long, turn long, role string, text string"


def random_rows(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rnd.choice([0, 1, 2, 5, 8, 12])):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            if rnd.random() < 0.7:
                role = ("user", "assistant")[turn % 2]
            text = rnd.choice(["Yes.", "No?", f"t{rnd.randrange(99)}.", "cut off", " \t", "", None, "… ", "é! \n"])
            rows.append((conv, rnd.choice([turn] * 9 + [None]), role, text))
    rows += [(None, t, ("user", "assistant")[t % 2], f"n{t}.") for t in range(6)]
    rows += [(900, 3, "user", "same."), (900, 3, "user", "same."), (901, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    if seed == 2:
        for name in ("key", "content", "copies", "cost", "audit", "part", "no", "kept", "line", "sha", "_copies"):
            df = df.selectExpr("*", f"'theirs' as {name}")
    got = [tuple(r) for r in repair.digests(df).select(*COLUMNS).collect()]
    assert len(got) == len({r[0] for r in rows})
    assert set(got) == plain(rows)


@pytest.mark.parametrize(("size", "held"), [(5, 3), (64, 256)])
def test_a_conversation_over_several_tasks(spark, size, held):
    rnd = random.Random(size)
    rows = [
        (7, t, rnd.choice(["user", "assistant", ("user", "assistant")[t % 2], "system"]), f"w{rnd.randrange(400)}.")
        for t in range(700)
    ]
    rows += [(7, 333, "user", "again.")] * 40 + [(c, t, "user", "Hi.") for c in (3, 9) for t in range(3)]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = {tuple(r) for r in repair.digests(df, size=size, held=held).select(*COLUMNS).collect()}
    assert got == plain(rows)


def test_search_takes_the_least_of_all_cheapest_edits():
    """Against the enumeration of all edit strings of short conversations."""
    cost_of = {"D": 2, "I": 5, "K": 0, "R": 1}

    def all_edits(kinds):
        found = []
        slots = [["", "I", "II"] for _ in range(len(kinds) + 1)]
        for ins in itertools.product(*slots):
            for letters in itertools.product(*[("D",) if k == "x" else ("D", "K", "R") for k in kinds]):
                audit = "".join(i + e for i, e in zip(ins, [*letters, ""], strict=True))
                if audit.count("I") > 3:
                    continue
                options = [""]
                at = 0
                for e in audit:
                    if e == "I":
                        options = [o + r for o in options for r in "ua"]
                        continue
                    k = kinds[at]
                    at += 1
                    if e == "K":
                        options = [o + k.lower() for o in options]
                    elif e == "R":
                        options = [o + r for o in options for r in "ua"]
                if any(ACCEPTED.fullmatch(o) for o in options):
                    extra = sum(
                        5 for k, e in zip(kinds, letters, strict=True) if k.isupper() and e != "D"
                    )
                    found.append((sum(cost_of[e] for e in audit) + extra, audit))
        return min(found)

    for n in range(4):
        for kinds in itertools.product("suaoUAx", repeat=n):
            tokens = [(k, 1) for k in kinds]
            assert repair.Search(tokens, None).from_state(0) == all_edits(kinds)


def test_tables_multiply_to_the_whole_search():
    rnd = random.Random(3)
    for _ in range(60):
        tokens = [(rnd.choice("suaoUAx"), 1) for _ in range(rnd.randint(4, 14))]
        cuts = sorted(rnd.sample(range(1, len(tokens)), 3))
        parts = [tokens[a:b] for a, b in itertools.pairwise([0, *cuts, len(tokens)])]
        tables = [repair.table(p) for p in parts]
        left = repair.product(repair.product(tables[0], tables[1]), repair.product(tables[2], tables[3]))
        assert left == repair.table(tokens)
        path, goal = "", None
        for part, (a, b) in zip(parts, repair.ends(tables, 0, None), strict=True):
            path += repair.Search(part, b).from_state(a)[1]
            goal = b
        assert path + repair.END[goal] == repair.Search(tokens, None).from_state(0)[1]


def test_empty_table(spark):
    assert repair.digests(spark.createDataFrame([], KIND)).count() == 0
