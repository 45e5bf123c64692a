"""Conversation structure repair by a dynamic programme over retained turns.

A turn is kept, given another role, or deleted, and empty turns can be inserted, so that the roles come
as an optional system turn and pairs of user and assistant. The programme goes over retained turns only:
what lies between two of them is priced by prefix sums of deletions, taken from a running minimum for each
role that the turn before may have, and the pair of roles tells the inserts. Equal costs are told apart
by their audits, the initials of the edits.

Rows are sorted by ranges of (conversation, turn). Conversations that lie inside a range, as nearly all do,
are solved there. The others are cut into chunks, which are solved for every role that may come before
them; chunks of a conversation combine like matrices, so one of any length spreads over tasks.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from llm.common import bounded, ddl, shuffle_partitions, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs of edits, and of an undeleted truncated turn
CHUNK = 2048  # turns of a conversation that are solved at once
CHUNK_CHARS = 4 << 20
BLANK = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

# The role of the last retained turn: none yet, system, user, assistant.
STATES = ("", "s", "u", "a")
NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}  # the role that an inserted or reroled turn takes
#: inserts between a retained turn and the next, by their roles; pairs that aren't here can't be
BETWEEN = {(p, r): int(NEXT[p][0] != r) for p in STATES for r in "ua"} | {("", "s"): 0}
AT_END = {"": 0, "s": 2, "u": 1, "a": 0}

Best = tuple[int, str]  # a cost and its audit


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, alive``: damage by a checksum of ``conv_id:turn``; dropped rows aren't alive.

    Nulls of the key, roles and texts count as one space; ``turn`` stays as it is.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    new = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        new.alias("text"), (fault != 0).alias("alive"), F.explode(times).alias("copy"),
    ).drop("copy")


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"), F.lit(True).alias("alive"))


# --- one run of turns ------------------------------------------------------------------------------


def mark(role: str, text: str) -> bytes:
    """What tells turns of different role or text apart."""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "replace")).digest()


def faults(texts: list[str], repeated: list[bool]) -> list[str]:
    """The first fault of each turn: b(lank), d(uplicate), t(runcated), or none."""
    out = []
    for text, again in zip(texts, repeated):
        own = text.rstrip(BLANK)
        out.append("b" if not own else "d" if again else "" if own[-1] in ".!?" else "t")
    return out


def retained(initials: list[str], found: list[str], start: str = "") -> dict[str, Best]:
    """The cheapest edits of a run of turns for each role that its last retained turn may have.

    ``start`` is the role of the last one retained before the run; inserts come right before a retained
    turn, so those after the last one are left to what follows. Of equal costs the least audit is best:
    all audits that are compared end with an edit of the same turn, so none begins with another.
    """
    gone = [0, *accumulate(DELETE for _ in initials)]  # costs of deleting the first turns
    least = {start: (0, "", 0)}  # by role: cost less deletions so far, audit, and the turns that it covers
    grown = lambda audit, covered, until: audit + "D" * (until - covered)
    for i, (initial, fault) in enumerate(zip(initials, found)):
        if fault in ("b", "d"):
            continue
        new = {}
        for role in "sua":
            if role != initial and role == "s":
                continue
            own, edit = (KEEP, "K") if role == initial else (REROLE, "R")
            best: Best | None = None
            for before, (cost, audit, covered) in least.items():
                if (inserts := BETWEEN.get((before, role))) is None:
                    continue
                price = cost + gone[i] + INSERT * inserts + own + TRUNCATED * (fault == "t")
                if best is None or price <= best[0]:
                    line = grown(audit, covered, i) + "I" * inserts + edit
                    best = min(best, (price, line)) if best else (price, line)
            if best:
                new[role] = best
        for role, (price, line) in new.items():
            base = price - gone[i + 1]
            old = least.get(role)
            if old is None or base < old[0] or (base == old[0] and line < grown(old[1], old[2], i + 1)):
                least[role] = (base, line, i + 1)
    n = len(initials)
    return {role: (cost + gone[n], grown(audit, covered, n)) for role, (cost, audit, covered) in least.items()}


def closed(ends: dict[str, Best]) -> Best:
    """The best of all ends, with the inserts that complete the last pair."""
    return min((cost + INSERT * AT_END[role], audit + "I" * AT_END[role]) for role, (cost, audit) in ends.items())


def edited(audit: str, roles: list[str], texts: list[str], start: str = "") -> list[tuple[str, str]]:
    """The turns that ``audit`` makes of a run, as ``(role, text)``."""
    out, state, i = [], start, 0
    for edit in audit:
        if edit == "I":
            out.append((NEXT[state], ""))
        elif edit != "D":
            out.append((roles[i], texts[i]) if edit == "K" else (NEXT[state], texts[i]))
        i += edit != "I"
        if edit != "D":
            state = out[-1][0][:1]
    return out


def counted(turns: list[int | None], initials: list[str], found: list[str]) -> dict:
    """Sums of a run that add up over runs: ``blank, duplicate, truncated, illegal``, turns and outer roles."""
    known = [t for t in turns if t is not None]
    return {
        "blank": found.count("b"), "duplicate": found.count("d"), "truncated": found.count("t"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "n": len(initials), "distinct": len(set(known)),
        "low": known[0] if known else None, "high": known[-1] if known else None,
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
    }


def added(a: dict, b: dict) -> dict:
    """Sums of two runs, one after the other."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "n", "distinct")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"first": a["first"], "last": b["last"]}


def gaps(sums: dict) -> int:
    return 0 if sums["low"] is None else min(sums["high"] - sums["low"] + 1 - sums["distinct"], (1 << 63) - 1)


class Digest:
    """SHA-256 of ``role:text`` lines as they come."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def add(self, roles: list[str], texts: list[str]) -> Digest:
        for role, text in zip(roles, texts):
            self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "replace"))
            self.some = True
        return self

    def hex(self) -> str:
        return self.hash.hexdigest()


# --- conversations ---------------------------------------------------------------------------------

_SUMS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_RUN = "turns array<bigint>, roles array<string>, texts array<string>, marks array<binary>"
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _arrow(kind: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(kind))


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _first_pass(rows: DataFrame) -> DataFrame:
    """Solved conversations (``done``) with their repaired turns, and chunks of the others with their turns as they are."""
    kind = f"conv_id {ddl(rows, 'conv_id')}, key string, part int, seq int, done boolean, {_SUMS}, sha256 string, {_RUN}"
    schema = _arrow(kind)

    def solved(turns, roles, texts) -> dict:
        initials, seen, again = [r[:1] for r in roles], set(), []
        for r, t in zip(roles, texts):
            again.append((r, t) in seen)
            seen.add((r, t))
        found = faults(texts, again)
        cost, audit = closed(retained(initials, found))
        sums, out = counted(turns, initials, found), edited(audit, roles, texts)
        roles, texts = [r for r, _ in out], [t for _, t in out]
        return {
            "done": True, "gaps": gaps(sums), **{k: sums[k] for k in _NUMBERS[1:]}, "cost": cost, "audit": audit,
            "sha256": Digest().add(roles, texts).hex(), "roles": roles, "texts": texts,
        }

    def chunk(turns, roles, texts) -> dict:
        return {"done": False, "turns": turns, "roles": roles, "texts": texts, "marks": [mark(r, t) for r, t in zip(roles, texts)]}

    def run(batches):
        part = TaskContext.get().partitionId()
        now, run_, seq, first, size, out = None, ([], [], []), 0, True, 0, []

        def flush(whole: bool) -> None:
            nonlocal seq, size, run_
            out.append({"conv_id": now[1], "key": now[0], "part": part, "seq": seq, **(solved if whole else chunk)(*run_)})
            seq, size, run_ = seq + 1, 0, ([], [], [])

        for b in batches:
            for key, conv, turn, role, text, alive in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "alive"))):
                if now is None or key != now[0]:
                    if now is not None:
                        flush(whole=not first and not seq)
                        first, seq = False, 0
                    now = (key, conv)
                if not alive:
                    continue
                if len(run_[0]) >= CHUNK or size > CHUNK_CHARS:
                    flush(whole=False)
                for column, value in zip(run_, (turn, role, text)):
                    column.append(value)
                size += len(text)
            if out:
                yield _rows(schema, out)
                out = []
        if now is not None:
            flush(whole=False)  # it may go on in the next range
            yield _rows(schema, out)

    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("salt")]
    rows = rows.withColumns({"key": key, "salt": F.rand(1)})  # the salt deals rows that are equal in all else
    rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return written(bounded(rows.select("key", "conv_id", "turn", "role", "text", "alive")).mapInArrow(run, kind), "runs")


def _in_order(df: DataFrame) -> DataFrame:
    return bounded(df.repartition("key").sortWithinPartitions("key", "part", "seq"))


_PATHS = "paths array<struct<before:string,after:string,cost:bigint,audit:string>>"
_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, n bigint, `distinct` bigint, low bigint, high bigint, `first` string, `last` string"


def _matrices(chunks: DataFrame) -> DataFrame:
    """Each chunk's cheapest edits for every role before it, and its sums. Repeats are found over all chunks first."""
    marks = chunks.select("key", "part", "seq", F.posexplode("marks").alias("i", "mark")).select("key", "mark", F.struct("part", "seq", "i").alias("at"))
    first = written(marks.groupBy("key", "mark").agg(F.min("at").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")
    again = marks.join(first, ["key", "mark"]).where("at > least").select("key", "at.part", "at.seq", "at.i")
    again = written(again.groupBy("key", "part", "seq").agg(F.collect_list("i").alias("again")), "again")  # within a chunk
    kind = f"conv_id {ddl(chunks, 'conv_id')}, key string, part int, seq int, {_PATHS}, {_COUNTS}"
    schema = _arrow(kind)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                again, initials = set(r["again"] or ()), [x[:1] for x in r["roles"]]
                found = faults(r["texts"], [i in again for i in range(len(initials))])
                paths = [
                    {"before": p, "after": q, "cost": c, "audit": a} for p in STATES for q, (c, a) in retained(initials, found, p).items()
                ]
                yield _rows(schema, [{**{c: r[c] for c in ("conv_id", "key", "part", "seq")}, "paths": paths, **counted(r["turns"], initials, found)}])

    rows = chunks.join(again, ["key", "part", "seq"], "left").select("conv_id", "key", "part", "seq", "turns", "roles", "texts", "again")
    return written(bounded(rows).mapInArrow(run, kind), "matrices")


def _combined(matrices: DataFrame) -> DataFrame:
    """Each chunk's part of its conversation's audit and the role before it; the last chunk also has the conversation's sums."""
    kind = f"conv_id {ddl(matrices, 'conv_id')}, key string, part int, seq int, before string, edits string, final boolean, {_SUMS}"
    schema = _arrow(kind)

    def solve(chunks: list[dict]) -> list[dict]:
        best, sums = {"": (0, "", ())}, counted([], [], [])
        for c in chunks:
            sums, new = added(sums, {k: c[k] for k in sums}), {}
            for p in c["paths"]:
                if p["before"] in best:
                    cost, audit, way = best[p["before"]]
                    x = (cost + p["cost"], audit + p["audit"], (way, p["before"], p["audit"]))
                    if p["after"] not in new or x[:2] < new[p["after"]][:2]:
                        new[p["after"]] = x
            best = new
        cost, audit = closed({role: x[:2] for role, x in best.items()})
        end = next(role for role, x in best.items() if (x[0] + INSERT * AT_END[role], x[1] + "I" * AT_END[role]) == (cost, audit))
        out, way = [], best[end][2]
        for c in reversed(chunks):
            way, before, edits = way
            out.append({**{k: c[k] for k in ("conv_id", "key", "part", "seq")}, "before": before, "edits": edits, "final": False})
        out[0] |= {"final": True, "edits": out[0]["edits"] + "I" * AT_END[end], "gaps": gaps(sums), **{k: sums[k] for k in _NUMBERS[1:]}, "cost": cost, "audit": audit}
        return out

    def run(batches):
        held = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["key"] != r["key"]:
                    yield _rows(schema, solve(held))
                    held = []
                held.append(r)
        if held:
            yield _rows(schema, solve(held))

    return written(_in_order(matrices).mapInArrow(run, kind), "edits")


def _repaired_chunks(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, key, part, seq, roles, texts``: chunks after their edits."""
    kind = f"conv_id {ddl(chunks, 'conv_id')}, key string, part int, seq int, roles array<string>, texts array<string>"
    schema = _arrow(kind)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                out = edited(r["edits"], r["roles"], r["texts"], r["before"])
                same = {c: r[c] for c in ("conv_id", "key", "part", "seq")}
                yield _rows(schema, [same | {"roles": [x for x, _ in out], "texts": [x for _, x in out]}])

    rows = chunks.join(edits.select("key", "part", "seq", "before", "edits"), ["key", "part", "seq"])
    return written(bounded(rows.select("conv_id", "key", "part", "seq", "roles", "texts", "before", "edits")).mapInArrow(run, kind), "pieces")


def _digests(pieces: DataFrame) -> DataFrame:
    """``key, sha256`` of conversations in several pieces; a digest reads its text in order, a piece at a time."""

    def run(batches):
        now, digest = None, Digest()
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                if now is not None and r["key"] != now:
                    yield pa.RecordBatch.from_pydict({"key": [now], "sha256": [digest.hex()]})
                    digest = Digest()
                now = r["key"]
                digest.add(r["roles"], r["texts"])
        if now is not None:
            yield pa.RecordBatch.from_pydict({"key": [now], "sha256": [digest.hex()]})

    return _in_order(pieces.select("key", "part", "seq", "roles", "texts")).mapInArrow(run, "key string, sha256 string")


class Repair:
    """The repair of all conversations in ``rows(conv_id, turn, role, text, alive)``, of ``damaged`` or ``undamaged``.

    Turns come by ``turn``, nulls first, rows of one turn by role and a hash of the text. A turn's first
    fault counts: blank, duplicate (role and text came before), truncated (its last visible character isn't
    one of ``.!?``). A role counts by its first character. Null conversation ids are one conversation;
    conversations whose rows are all dropped have zeros and an empty audit; an empty table gives an empty
    result. Repeated rows are turns of their own, and duplicates. Further columns are not carried.
    """

    def __init__(self, rows: DataFrame):
        self._runs = _first_pass(rows)
        chunks = self._runs.where("not done")
        self._edits = _combined(_matrices(chunks))
        self._pieces = _repaired_chunks(chunks, self._edits)

    def turns(self) -> DataFrame:
        """The repaired turns: ``conv_id, part, seq, place, role, text``; the order is by part, seq and place."""
        columns = ["conv_id", "part", "seq", "roles", "texts"]
        rows = self._runs.where("done").select(*columns).unionByName(self._pieces.select(*columns))
        one = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x")
        return rows.select("conv_id", "part", "seq", one).select("conv_id", "part", "seq", "place", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))

    def report(self) -> DataFrame:
        """A row per conversation: ``conv_id``, counts of faults, ``cost``, ``audit`` and ``repaired_sha256``."""
        names = ["conv_id", *_NUMBERS, "cost", "audit", F.col("sha256").alias("repaired_sha256")]
        long = self._edits.where("final").join(_digests(self._pieces), "key")
        return self._runs.where("done").select(*names).unionByName(long.select(*names))
