import random

from llm import linededup as d


def plain(rows, words):
    """Lines in any run of enough words that stands earlier, by comparing all pairs of places."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    docs = [(r, [x.strip() for x in r[1].split("\n")]) for r in order if r[1] is not None]
    gone = {r: set() for r in order}
    places = [(r, p, lines) for r, lines in docs for p in range(len(lines))]
    for k, (r, p, lines) in enumerate(places):
        for _, q, other in places[:k]:
            n = 0
            while p + n < len(lines) and q + n < len(other) and lines[p + n] == other[q + n]:
                n += 1
            if sum(len(x.split()) for x in lines[p : p + n]) >= words:
                gone[r].update(range(p, p + n))
    return gone


def test_matches_brute_force(spark):
    rnd = random.Random(7)
    pool = [" ".join(rnd.choices("abcdef", k=rnd.randint(0, 9))) for _ in range(14)]
    rows = [(i, "\n".join(rnd.choice(["", " "]) + rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x " * 40_000), (104, "x " * 40_000), (105, "a b c d e f\n" * 9), (5, rows[5][1]), (None, rows[7][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    want = plain(rows, 12)
    assert sum(map(bool, want.values())) > 20
    got = d.deduplicated(df, 12).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r)
    for r in set(rows):
        lines = r[1].split("\n") if r[1] is not None else []
        kept = "\n".join(x for k, x in enumerate(lines) if k not in want[r]) if r[1] is not None else None
        assert any((x.text, x.n_lines, x.n_cut) == (kept, len(lines), len(want[r])) for x in texts[r[0]])


def test_empty(spark):
    assert d.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
