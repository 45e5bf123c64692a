import hashlib
import random
import re

from llm import secrets as s

PATTERNS = {
    "assign": (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def plain(text):
    got = [(m.start(), k, r, m.end()) for k, (r, (p, ok)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{r}:{a}:{b}" for a, _, r, b in sorted(got)]


def texts(rnd):
    bits = ["password", "API_key", "apikey", "Token", "ſecret", "toKen", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH0123456789", "deadbeef" * 3,
            "abc", "xyz-9", "é日", "\n", "x" * 7, "secret=password=abcdef", "-----BEGIN PRIVATE KEY-----\nAAA=\n-----END PRIVATE KEY-----"]
    return ["".join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(200)]


def test_matches_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, t, "x") for i, t in enumerate(texts(rnd))]
    rows += [(i + 1000, rnd.choice(rows)[1], "x") for i in range(100)]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "token=" + "a" * 200_000, "x"), (5, rows[5][1], "x"), (5, "token=abcdefg", "x"), (None, "token=abcdefg", "x")]
    got = s.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    seen, want = [], []
    for r in got:
        base = [x for x in r.spans.split(",") if x.split(":")[0] in s.BASE]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in s.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        seen.append((r.doc_id, ",".join(base)))
    want = [(i, ",".join(plain(t))) for i, t, _ in rows]
    assert sorted(seen, key=key) == sorted(want, key=key)


def test_only_unseen_pairs_are_scanned(spark):
    v1 = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "plain")], "doc_id long, text string")
    _, ledger = s.update(v1, None, {"assign": 1})
    assert ledger.count() == 2
    marked = ledger.where("size(spans) > 0").selectExpr("blob", "rule", "version", "array(array(70L, 71L)) as spans").unionByName(ledger.where("size(spans) = 0"))
    v2 = spark.createDataFrame([(1, "token=abcdef"), (4, "secret: 1234567")], "doc_id long, text string")
    paths, new = s.update(v2, marked, {"assign": 1, "hex": 1})
    assert new.count() == 3  # one new blob under two rules, one known blob under the new rule
    ledger = marked.unionByName(new)
    found = {r.doc_id: [(x.rule, x.start) for x in r.found] for r in s.findings(paths, ledger).collect()}
    assert found == {1: [("assign", 70)], 4: [("assign", 0)]}  # 70: as the ledger says, not scanned again
    _, again = s.update(v2, ledger, {"assign": 2, "hex": 1})
    assert again.count() == 2  # a rule's new version is another pair


def test_history_in_a_kept_ledger(spark, tmp_path):
    rnd, path = random.Random(8), str(tmp_path / "ledger")
    rows = [(i % 60, rnd.choice(texts(rnd))) for i in range(150)] + [(1, None), (2, ""), (None, "token=abcdefg")]
    parts = [spark.createDataFrame(rows[k::3], "doc_id long, text string") for k in range(3)]
    got = sorted((str(r.doc_id), r.base_sha256) for r in s.scan_history(parts, path).collect())
    assert got == sorted((str(i), hashlib.sha256(",".join(plain(t)).encode()).hexdigest()) for i, t in rows)
    ledger = s.recorded(spark, path)
    assert ledger.count() == len({t or "" for _, t in rows}) * len(s.RULES)  # each blob once under each rule
    assert s.update(parts[1], ledger)[1].count() == 0


def test_empty(spark):
    assert s.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
