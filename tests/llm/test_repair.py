import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from arborq.llm import repair
from tests.llm.helpers import odd_texts

SCHEMA = "conv_id long, turn long, role string, text string, place long, audit string, conv string, kind string"
GRAMMAR = re.compile("(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if how:
            x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
            out += [(c, t, "user" if how == 4 else r, x)] * (2 if how == 3 else 1)
    return out


def order(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3])


def faults_of(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        said = BLANK.findall(x)
        out.append("blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((r, x))
    return out


def cheapest(roles, faults, inserts=2):
    """All sequences of edits with up to `inserts` insertions in any place, by hand: the least (cost, audit), and the rows' roles."""
    best = None
    gaps = [list(range(inserts + 1))] * (len(roles) + 1)
    for edits in itertools.product(*["D" if f in ("blank", "duplicate") else "KRD" for f in faults]):
        for ins in itertools.product(*gaps):
            audit = "I" * ins[0] + "".join(e + "I" * k for e, k in zip(edits, ins[1:], strict=True))
            cost = 2 * sum(ins) + sum({"K": 0, "R": 2, "D": 3}[e] for e in edits) + sum(f == "truncated" and e != "D" for e, f in zip(edits, faults, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            open_, left = [], iter(zip(edits, roles, strict=True))
            for a in audit:
                if a == "I":
                    open_.append("ua")
                else:
                    e, role = next(left)
                    open_ += [role[:1] or "-"] if e == "K" else ["ua"] if e == "R" else []
            for said in itertools.product(*open_):
                if GRAMMAR.fullmatch("".join(said)):
                    best = (cost, audit, said)
                    break
    return best


def by_hand(rows):
    out = []
    done = damage(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in done if r[0] == c), key=order)
        roles, faults = [r[2] for r in own], faults_of(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, said = cheapest(roles, faults)
        left, lines, n = iter(own), [], 0
        for a in audit:
            row = None if a == "I" else next(left)
            if a != "D":
                lines.append((row[2] if a == "K" else {"u": "user", "a": "assistant"}[said[n]]) + ":" + (row[3] if row else ""))
                n += 1
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, repair.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)


def random_rows(r, convs, most=5):
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(r.randrange(1, most + 1)):
            turn += r.choice([0, 1, 1, 1, 1, 2, 9])
            rows.append((c, r.choice([turn] * 12 + [None]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "", None]), r.choice(["Yes.", "No!", f"text {r.random()}.", f"cut {r.random()}", " \t", "", None, "end? \n"])))
    return rows


def test_query_against_all_edits(spark, tmp_path):
    r = random.Random(3)
    rows = random_rows(r, 70, 4)
    rows += [(None, t, "user", f"n{t}.") for t in (1, 2, None)] + [(777, i, "assistant", t) for i, t in enumerate(odd_texts()[:4])]
    rows += [(r, t, x, y) for r, t, x, y in [(-(2**63), 2**62, "user", "a."), (900, 1, "user", "a."), (900, 1, "user", "a.")]]
    r.shuffle(rows)
    assert query(spark, frame(spark, rows).repartition(3), tmp_path) == by_hand(rows)


@pytest.mark.parametrize("seed", range(2))
def test_transitions_against_all_edits(seed):
    """Longer conversations, by the steps alone."""
    r = random.Random(seed)
    steps = {}
    for kind, s, e, c, a in repair.transitions():
        steps.setdefault((kind, s), []).append((e, c, a))
    for _ in range(25):
        roles = [r.choice("suao") for _ in range(r.randrange(1, 5))]
        faults = [r.choice([None, None, None, "truncated", "blank"]) for _ in roles]
        ways = {repair.BEFORE: (0, "")}
        for role, f in zip(roles, faults, strict=True):
            kind, new = "d" if f == "blank" else role + ("t" if f else ""), {}
            for s, (c0, a0) in ways.items():
                for e, c, a in steps[kind, s]:
                    new[e] = min(new.get(e, (999, "")), (c0 + c, a0 + a))
            ways = new
        assert min(ways[s] for s in repair.FINAL if s in ways) == cheapest(roles, faults)[:2]


def simple(own):
    """The same program in plain Python, without segments."""
    steps = {}
    for kind, s, e, c, a in repair.transitions():
        steps.setdefault((kind, s), []).append((e, c, a))
    ways = {repair.BEFORE: (0, "")}
    for (_, _, role, _), f in zip(own, faults_of(own), strict=True):
        kind = "d" if f in ("blank", "duplicate") else (role[0] if role[:1] in ("s", "u", "a") and role else "o") + ("t" if f else "")
        new = {}
        for s, (c0, a0) in ways.items():
            for e, c, a in steps[kind, s]:
                new[e] = min(new.get(e, (1 << 60, "")), (c0 + c, a0 + a))
        ways = new
    return min(ways[s] for s in repair.FINAL if s in ways)


def test_hot_conversations_go_through_segments_and_levels(spark, monkeypatch):
    r = random.Random(9)
    text = lambda: r.choice(["", f"t {r.random()}.", f"t {r.random()}", "same."])
    rows = [(1, t, r.choice(["user", "assistant", "system"]), text()) for t in range(3000)] + [(c, t, r.choice(["user", "assistant"]), text()) for c in range(2, 90) for t in range(c % 9 + 1)]
    r.shuffle(rows)
    want = {}
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=order)
        want[c] = (*simple(own), sum(a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), len(own))
    for shift in (2, 8):
        monkeypatch.setattr(repair, "SHIFT", shift)
        if shift == 2:  # workers read the module anew, so that the smaller segments come from a smaller place
            known = repair.faults(repair.placed(frame(spark, rows), 7)).withColumn("place", repair.F.expr("(place >> 33 << 33) + ((place & 8589934591) << 6)"))
        else:
            known = repair.faults(repair.placed(frame(spark, rows), 7))
        monkeypatch.setattr(repair, "SHIFT", 8)
        best, illegal = repair.search(known)
        got = {x["conv"]: (x["cost"], x["audit"]) for x in best.collect()}
        bad = {x["conv"]: x["illegal"] for x in illegal.collect()}
        assert {c: (*got[f"={c}"], bad[f"={c}"]) for c in want} == {c: w[:3] for c, w in want.items()}


def test_rows_are_the_repair(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (2, 0, "tool", "x."), (2, 5, "assistant", "cut")]
    fixed = repair.repair(frame(spark, rows))
    got = [tuple(x) for x in fixed.rows.orderBy("conv_id", "seq").collect()]
    assert [x[2] + (x[4] or "")[:1] + ":" + x[5] for x in got if x[0] == 1] == ["Iu:", "Ka:Hello.", "Ku:Hi.", "Du:Hi.", "Ia:"]
    assert [x[2] + x[4][:1] for x in got if x[0] == 2] == ["Ru", "Ka"]
    assert {x["conv_id"]: (x["gaps"], x["cost"], x["audit"]) for x in fixed.conversations.collect()} == {1: (0, 7, "IKKDI"), 2: (4, 3, "RK")}


def test_empty_table(spark, tmp_path):
    assert query(spark, frame(spark, []), tmp_path) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_on_the_tables(spark):
    turns = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {x["conv_id"]: x for x in repair.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    done = damage(turns)
    assert set(got) == {x[0] for x in turns}
    for c in got:
        own = sorted((x for x in done if x[0] == c), key=order)
        assert (got[c]["cost"], got[c]["audit"]) == (simple(own) if own else (0, ""))
