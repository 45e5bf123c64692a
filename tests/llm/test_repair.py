import hashlib
import random
import re
import zlib

import pytest

from llm import repair as r

NEED = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(name.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_edits(initials, faults):
    """All edits, from the end: cost and audit by (turn, role before)."""
    n, memo = len(initials), {}

    def go(i, state, inserts=0):
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        options = [(0, "")] if i == n and state in ("", "a") else []
        if i < n:
            options.append((3 + go(i + 1, state)[0], "D" + go(i + 1, state)[1]))
            if faults[i] not in ("b", "d"):
                more = faults[i] == "t"
                wanted = NEED[state][1]
                if initials[i] == wanted or (initials[i] == "s" and state == ""):
                    c, a = go(i + 1, initials[i])
                    options.append((c + more, "K" + a))
                c, a = go(i + 1, wanted)
                options.append((c + more + 2, "R" + a))
        if inserts < 2:
            c, a = go(i, NEED[state][1], inserts + 1)
            options.append((c + 2, "I" + a))
        memo[i, state, inserts] = min(options, default=(10**9, ""))
        return memo[i, state, inserts]

    return go(0, "")


def plain(rows):
    """By conversation: what the report says."""
    out, all_ids = {}, {x[0] for x in rows}
    kept = plain_damage(rows)
    for conv in all_ids:
        own = [x[1:] for x in kept if x[0] == conv]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        initials, seen, faults = [x[1][:1] for x in own], set(), []
        for _, role, text in own:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not visible else "d" if (role, text) in seen else "" if visible[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = plain_edits(initials, faults)
        state, i, lines = "", 0, []
        for e in audit:
            if e != "D":
                role = own[i][1] if e == "K" else NEED[state][0]
                lines.append(f"{role}:{'' if e == 'I' else own[i][2]}")
                state = role[:1]
            i += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        turns = [x[0] for x in own if x[0] is not None]
        gap = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gap, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def test_retained_is_the_cheapest_and_least_of_all_edits():
    rnd = random.Random(2)
    for _ in range(600):
        n = rnd.randint(0, 9)
        initials = [rnd.choice(["s", "u", "a", "x", ""]) if rnd.random() < 0.3 else rnd.choice("ua") for _ in range(n)]
        faults = [rnd.choice(["", "", "", "t", "b", "d"]) for _ in range(n)]
        assert r.closed(r.retained(initials, faults)) == plain_edits(initials, faults)


def test_chunks_combine_to_the_same_edits():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(0, 12)
        initials, faults = [rnd.choice("suax") for _ in range(n)], [rnd.choice(["", "", "t", "b"]) for _ in range(n)]
        cuts = sorted(rnd.randint(0, n) for _ in range(3))
        best = {"": (0, "")}
        for lo, hi in zip([0, *cuts], [*cuts, n]):
            new = {}
            for before, (cost, audit) in best.items():
                for after, (c, a) in r.retained(initials[lo:hi], faults[lo:hi], before).items():
                    new[after] = min(new.get(after, (10**9, "")), (cost + c, audit + a))
            best = new
        assert r.closed(best) == plain_edits(initials, faults)


def conversations():
    rnd = random.Random(5)
    rows = []
    for conv in [*range(60), None, -4]:
        for turn in range(rnd.choice([1, 2, 5, 9])):
            role = rnd.choice(["system"] if turn == 0 and rnd.random() < 0.4 else ["user", "assistant", "assistant", "tool", "", None])
            text = rnd.choice(["Hi there.", "No end", "", " \t\x0b", None, "Why? Ok!  ", "Ünï.", " "])
            rows.append((conv, rnd.choice([turn * 2 - 1, turn * 2 - 1, turn * 2 - 1, None]), role, text))
    rows = [x for k, x in enumerate(rows) if x[:2] not in {y[:2] for y in rows[:k]}]  # equal turns are ordered by a hash
    for turn in range(150):  # one conversation over many chunks and ranges
        rows.append((1000, turn + turn // 40, ["user", "assistant", "system"][rnd.choice([0, 1, 0, 1, 2])], rnd.choice(["A b.", "C d", "E f!", f"{turn}.", ""])))
    return rows + [x for x in rows[:5]]  # repeated rows


@pytest.mark.parametrize("chunk", [2048, 7])
def test_report_and_turns_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(r, "CHUNK", chunk)
    rows = conversations()
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "conv_id long, turn long, role string, text string, key string, part int").repartition(5)
    done = r.Repair(r.damaged(df))
    got = {x.conv_id: tuple(x)[1:] for x in done.report().collect()}
    assert got == plain(rows)
    turns = {}
    for x in sorted(done.turns().collect(), key=lambda x: (x.part, x.seq, x.place)):
        turns.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    for conv, x in got.items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == x[-1]


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes?"), (2, 5, "user", "Go."), (2, 6, "assistant", "Ok.")]
    done = r.Repair(r.undamaged(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))
    got = {x.conv_id: x for x in done.report().collect()}
    assert (got[1].cost, got[1].audit, got[2].cost, got[2].audit, got[2].gaps) == (0, "KKK", 0, "KK", 0)


def test_very_long_texts_and_equal_rows(spark):
    rows = [("x", 1, "user", "w " * 300_000 + ".")] * 40 + [("y", None, "assistant", "z" * 100_000)] * 3
    got = {x.conv_id: tuple(x)[1:7] for x in r.Repair(r.undamaged(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).report().collect()}
    assert got == {"x": (0, 0, 39, 0, 39, 3 * 39 + 2), "y": (0, 0, 2, 1, 2, 3 + 6)}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert r.Repair(r.damaged(df)).report().collect() == []
