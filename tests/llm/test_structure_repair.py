"""Structure repair against a direct evaluation of its definition."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from kinmatch.llm import structure_repair
from kinmatch.llm.queries import QUERIES

SEEN = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(codes):
    """(cost, audit, symbols) by trying every edit at every turn, from the end."""

    @lru_cache(maxsize=None)
    def rest(i, state, inserted):
        # States: start, after a system turn (d), after whole pairs (p), within a pair (o).
        found = []
        if i == len(codes) and state in ("start", "p"):
            found.append((0, "", ()))
        following = "o" if state != "o" else "p"
        symbol = "a" if state == "o" else "u"
        if inserted < 2:
            cost, audit, out = rest(i, following, inserted + 1)
            found.append((cost + 2, "I" + audit, (symbol, *out)))
        if i < len(codes):
            initial, fault = codes[i]
            cost, audit, out = rest(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault == "truncated" else 0
                cost, audit, out = rest(i + 1, following, 0)
                found.append((cost + extra + 2, "R" + audit, (symbol, *out)))
                if initial == symbol:
                    found.append((cost + extra, "K" + audit, (None, *out)))
                if initial == "s" and state == "start":
                    cost, audit, out = rest(i + 1, "d", 0)
                    found.append((cost + extra, "K" + audit, (None, *out)))
        return min(found, key=lambda f: f[:2], default=(1 << 40, "", ()))

    # Three insertions in a row hold a pair that could be left out, but for the first pair.
    return rest(0, "start", 0)


def byte(initial, fault):
    first = structure_repair.INITIALS.get(initial, structure_repair.OTHER)
    return first + {"": 0, "blank": 4, "duplicate": 8, "truncated": 16}[fault]


def brute(rows):
    """The contract's columns for each conversation of (conv, turn, role, text) rows."""
    answer = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes = set(), []
        for _, role, text in kept:
            shown = SEEN.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            codes.append((role[:1], fault))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = min(2**63 - 1, max(numbers) - min(numbers) + 1 - len(set(numbers))) if numbers else 0
        illegal = sum((a[0], b[0]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(codes, codes[1:]))
        cost, audit, out = cheapest(tuple(codes))
        lines, at, left = [], 0, iter(out)
        for letter in audit:
            if letter == "I":
                lines.append({"u": "user", "a": "assistant"}[next(left)] + ":")
                continue
            _, role, text = kept[at]
            at += 1
            if letter != "D":
                symbol = next(left)
                lines.append(({"u": "user", "a": "assistant"}[symbol] if letter == "R" else role) + ":" + text)
        faults = [f for _, f in codes]
        answer[conv] = (
            gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return answer


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("stretch", [1, 2, 3, 5, 64])
def test_least_cost_and_audit_in_stretches_of_any_length(stretch):
    chance = random.Random(stretch)
    kinds = [(i, f) for i in "uasx" for f in ("", "truncated", "blank", "duplicate")]
    weights = [8, 2, 1, 1] * 2 + [4, 1, 1, 1] + [2, 2, 1, 1]
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 14] * 25:
        codes = tuple(chance.choices(kinds, weights, k=n))
        cost, edits = structure_repair.align(bytes(byte(*c) for c in codes), stretch)
        wanted = cheapest(codes)
        assert (cost, "".join(e for e, _ in edits)) == wanted[:2], codes


def test_long_conversation_equals_one_table():
    chance = random.Random(5)
    codes = bytes(chance.choices([0, 1, 2, 3, 16, 17, 4, 9], [40, 40, 2, 3, 5, 5, 3, 2], k=3000))
    cost, edits = structure_repair.align(codes)
    assert (cost, edits) == structure_repair.align(codes, 1000)
    kept = [e for e, _ in edits if e in "KRD"]
    assert len(kept) == len(codes)


def test_query_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_structure_repair"](spark, sf)) == brute(rows)


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    long = "word " * 200_000 + "end."
    rows = [(None, t, "user", "no id.") for t in (None, 1, 2)]
    rows += [(1, None, None, None), (1, None, "user", None), (1, 3, "", "a."), (1, 3, "", "a."), (1, 2**62, "assistant", "b?"), (1, -(2**63) + 1, "u", "c!")]
    rows += [(2, t, "user" if t % 2 else "assistant", long) for t in range(4)]
    rows += [(3, 5, "system", "only one.")] * 3 + [(4, t, "Ünknown", " ") for t in range(6)]
    rows += [(5, t, ("user", "assistant")[t % 2], f"turn {t}. ") for t in range(300)]
    rows += [(c, 0, "user", "one.") for c in range(100, 160)]
    table = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, at int, byte int, part string")
    result = structure_repair.repaired(structure_repair.damaged(table.repartition(5)))
    answer = found(result)
    assert answer == brute(rows)
    lost = [c for c in range(100, 160) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost and all(answer[c] == (0, 0, 0, 0, 0, 0, "", structure_repair.EMPTY) for c in lost)
    assert structure_repair.repaired(structure_repair.damaged(table.limit(0))).count() == 0
