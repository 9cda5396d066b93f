"""Conversation repair against plain recursion and against all edit sequences."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from compostat.llm import dialogues as D
from compostat.llm import queries as Q

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """(cost, letters) by recursion over positions and states, comparing whole strings."""

    @lru_cache(None)
    def left(i, q, inserted):
        found = [(0, "")] if i == len(symbols) and q in (0, 3) else []
        if inserted < 3:
            for to in {D._NEXT[q][c] for c in "ua" if c in D._NEXT[q]}:
                cost, letters = left(i, to, inserted + 1)
                found.append((cost + 3, "I" + letters))
        if i < len(symbols):
            s = symbols[i]
            moves = [(4, "D", q)]
            if s != D.MUST_GO:
                extra = 3 * (s & 1)
                if "suax"[s >> 1] in D._NEXT[q]:
                    moves.append((extra, "K", D._NEXT[q]["suax"[s >> 1]]))
                moves += [(3 + extra, "R", D._NEXT[q][c]) for c in "ua" if c in D._NEXT[q]]
            for cost, letter, to in moves:
                rest = left(i + 1, to, 0)
                found.append((cost + rest[0], letter + rest[1]))
        return min(found, default=(10**9, ""))

    for i in range(len(symbols), -1, -1):  # from the end, so that recursion stays shallow
        for q in range(4):
            left(i, q, 0)
    return left(0, 0, 0)


def all_sequences(symbols):
    """(cost, letters) by trying every sequence of edits with at most three insertions a gap."""
    best = []
    gaps = [g for n in range(4) for g in itertools.product("ua", repeat=n)]
    for new in itertools.product(gaps, repeat=len(symbols) + 1):
        for letters in itertools.product("KRUD", repeat=len(symbols)):
            roles, audit, cost = "", "", 0
            for k, letter in enumerate([*letters, None]):
                roles, audit, cost = roles + "".join(new[k]), audit + "I" * len(new[k]), cost + 3 * len(new[k])
                if letter is None:
                    continue
                s = symbols[k]
                if letter != "D" and s == D.MUST_GO:
                    break
                roles += {"D": "", "K": "suax"[s >> 1 & 3], "R": "u", "U": "a"}[letter]
                audit += "R" if letter == "U" else letter
                cost += 4 if letter == "D" else (0 if letter == "K" else 3) + 3 * (s & 1)
            else:
                if GOOD.fullmatch(roles):
                    best.append((cost, audit))
    return min(best)


def by_tables(symbols, at=None):
    t = D.tables()
    r = {"symbols": bytes(symbols), "behind": None, "begin": None, "final": None, "roles": ["suax"[s >> 1 & 3] for s in symbols], "texts": [""] * len(symbols)}
    got = D._edited(r | dict.fromkeys(("first", "last", "blank", "duplicate", "truncated", "illegal")))
    _, paid = t.back(bytes(symbols), t.end)
    marks, _ = t.back(bytes(symbols), t.end)
    assert paid + t.end_low + t.vectors[marks[0]][0] == got["cost"]
    roles = "".join(x[0] for x in got["lines"].split("\n")) if got["lines"] else ""
    assert GOOD.fullmatch(roles)
    return got["cost"], got["audit"]


def test_tables_against_recursion_and_all_sequences():
    for n in range(5):
        for symbols in itertools.product(range(D.SYMBOLS), repeat=n):
            if n < 2:
                assert all_sequences(symbols) == cheapest(symbols)
            if n < 4 or sum(symbols) % 7 == 0:
                assert by_tables(symbols) == cheapest(symbols)
    rng = random.Random(1)
    for _ in range(12):
        symbols = tuple(rng.randrange(D.SYMBOLS) for _ in range(2))
        assert all_sequences(symbols) == cheapest(symbols)
    for _ in range(300):
        symbols = tuple(rng.randrange(D.SYMBOLS) for _ in range(rng.randrange(5, 40)))
        assert by_tables(symbols) == cheapest(symbols)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_block_length_changes_nothing(block):
    rng = random.Random(block)
    t, u = D.Tables(block), D.tables()
    for _ in range(50):
        symbols = bytes(rng.randrange(D.SYMBOLS) for _ in range(rng.randrange(0, 20)))
        assert list(t.trace(symbols, t.end, 0)) == list(u.trace(symbols, u.end, 0))
        assert t.matrix(symbols) == u.matrix(symbols)


BARE = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """The contract's columns by id, from (conv, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort()
        seen, symbols, faults = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            ends = BARE.findall(text)
            fault = 0 if not ends else 1 if (role, text) in seen else 2 if ends[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            symbols.append(D.MUST_GO if fault in (0, 1) else 2 * ("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + (fault == 2))
        turns = {t for known, t, _, _ in mine if known}
        cost, audit = cheapest(tuple(symbols))
        lines, at = [], iter(mine)
        for c in audit:
            want = "assistant" if lines and lines[-1][0] == "u" else "user"
            if c == "I":
                lines.append(f"{want}:")
                continue
            _, _, role, text = next(at)
            if c != "D":
                lines.append(f"{role if c == 'K' else want}:{text}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows():
    rng = random.Random(2)
    texts = ["Yes.", "No!", "Why?", "and so on", "", " \n\t", "Yes. ", "…", None, "ends.\x1c", "a.b"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ua", "sys"]
    rows = [(rng.randrange(60), rng.choice([None, *range(-2, 12)]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += [(None, t, rng.choice(roles), f"text {t}.") for t in range(30)] + [(99, 0, "user", "hot.")] * 300
    rows += [(100, t, rng.choice(roles[:3]), f"line {t}" + rng.choice(["", "."])) for t in range(700)]
    rows += [(101, None, "user", None), (102, 5, "assistant", "x" * 50_000), (103, 1 << 40, "user", "far."), (103, 0, "assistant", "near.")]
    return rows + [(200 + k, t, "user", ".") for k in range(40) for t in range(1)]


def found(df, **kw):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = [(r["conv_id"], tuple(r[c] for c in cols)) for r in D.repair(df, **kw).collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in odd_rows()], "conv_id bigint, turn bigint, role string, text string, conv string, part int").repartition(5)


def test_against_brute_force(talks):
    assert found(talks) == brute(odd_rows())


@pytest.mark.parametrize(("rows", "chars"), [(7, 1 << 20), (1, 1), (10_000, 200)])
def test_many_segments(talks, rows, chars):
    assert D.segments(D.damage(talks), rows, chars).filter(F.octet_length("symbols") > rows).count() == 0
    assert found(talks, most_rows=rows, most_chars=chars) == brute(odd_rows())


def test_segments_put_together():
    rng = random.Random(4)
    t = D.tables()
    for _ in range(60):
        parts = [bytes(rng.randrange(D.SYMBOLS) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(2, 6))]
        key = [{"conv": 1, "part": 0, "serial": k, "symbols": p} for k, p in enumerate(parts)]
        behind = D._behind([r | {"matrix": t.matrix(r["symbols"])} for r in key])
        ends = [D._led_to(r | b) for r, b in zip(key, behind, strict=True)]
        audit = ""
        blank = dict.fromkeys(("first", "last", "blank", "duplicate", "truncated", "illegal"))
        for r, b in zip(key, D._begins(ends), strict=True):
            n = len(r["symbols"])
            audit += D._edited(r | b | blank | {"roles": ["suax"[s >> 1 & 3] for s in r["symbols"]], "texts": [""] * n})["audit"]
        assert audit == cheapest(tuple(b"".join(parts)))[1]


def test_query_and_empty(spark, talks):
    table = Q.table(spark, SF, "conversations")
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r["conv_id"]: tuple(r[c] for c in cols) for r in Q.op11_dialogue_repair(spark, SF).collect()}
    assert got == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert D.repair(talks.limit(0)).count() == 0
