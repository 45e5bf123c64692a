"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits wide. Bits are grouped into partitions, correlated bits together. If the
thresholds of the m partitions add up to tau - m + 1 (-1 leaves a partition out), two fingerprints
within tau differ by at most the threshold in one partition at least; a dynamic programme picks the
thresholds, and the number of partitions, by estimated candidates and probes.

``near_duplicates`` takes fingerprints within three bits as links. ``keep_first`` takes them as candidates
only, with fingerprints made of shorter shingles and a wider threshold, so that texts of a Jaccard similarity
of 0.8 rarely fall outside, and links the texts whose shingle sets are that similar.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded, ddl, fresh, written
from llm.components import connected_components, forest

SEED = 42
TAU = 3
SAMPLE = 4096  # fingerprints from which correlations and candidate counts are estimated
BLOCK = 16384  # fingerprints of one key that a task compares at once with as many others
TILE = 1 << 18  # pairs of fingerprints that are compared at once
HELD = 1 << 20  # links that a task holds before it reduces them to a forest
WIDE = 9  # bits within which texts are candidates for a comparison of their shingles
NARROW = 2  # words of the shingles that candidates' fingerprints are made of
SHINGLE = 5  # words of the shingles that are compared
SIMILAR = 0.8  # Jaccard similarity of shingle sets from which texts link
TEXTS = 512  # texts of a candidate group that a task compares at once with as many others
SET_BYTES = 16 << 20  # bytes of shingle sets of a block of texts, on average
BUCKETS = 64  # counts that a sketch of a shingle set has
_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], dtype=np.uint64)


def _hashes(text: str | None, words: int = 3) -> list[int]:
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) < words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[i:j], SEED) for i, j in zip(starts, ends[words - 1 :].tolist())]


def fingerprint_batch(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Unsigned fingerprints: a bit is set if it is set in over half the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    group, size = [], 0
    def flush() -> None:
        nonlocal group, size
        if group:
            out[[i for i, _ in group]] = _majority([h for _, h in group])
        group, size = [], 0
    for i, text in enumerate(texts):
        if hashes := _hashes(text, words):
            group.append((i, hashes))
            size += len(hashes)
            if size > 200_000:
                flush()
    flush()
    return out


def _majority(docs: list[list[int]]) -> np.ndarray:
    lengths = np.array([len(d) for d in docs])
    flat = np.concatenate([np.array(d, np.uint64) for d in docs])
    lanes = _SPREAD[flat.view(np.uint8)].reshape(-1, 8)
    cuts, first = [], []  # byte counters overflow after 255 rows
    start = 0
    for n in lengths.tolist():
        first.append(len(cuts))
        cuts.extend(range(start, start + n, 255))
        start += n
    counts = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
    totals = np.add.reduceat(counts.astype(np.int64), first, axis=0)
    return np.packbits(2 * totals > lengths[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long; null or blank texts have fingerprint zero."""
    kind = ddl(docs, "doc_id")

    def run(batches):
        for b in batches:
            fp = fingerprint_batch(b.column("text").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def correlated_partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each grows by the bit most correlated with those it has."""
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    left, groups = list(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, groups))) // (m - k)
        group = [max(left, key=lambda i: c[i, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda i: c[i, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, adding up to ``total``, of least cost; ``cost[i][t + 1]`` is of partition i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    return best[total]


def _near_pairs(values: np.ndarray, rows: int = 128) -> np.ndarray:
    """The number of ordered pairs, of different places, that differ in 0, 1 and 2 bits; some rows at a time."""
    counts = np.zeros(65, np.int64)
    for lo in range(0, len(values), rows):
        counts += np.bincount(np.bitwise_count(values[lo : lo + rows, None] ^ values).ravel(), minlength=65)
    counts[0] -= len(values)
    return counts[:3]


def plan_partitions(sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds for n fingerprints, estimated from ``sample``."""
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    scale = (n / max(1, len(sample))) ** 2 / 2
    options = []
    for m in range(-(-(tau + 1) // 3), tau + 2):  # a partition's threshold is 2 at most
        if m < 2:
            continue
        groups = correlated_partitions(bits.astype(float), m)
        cost = []
        for g in groups:
            at = _near_pairs(_squeeze(sample.astype(np.uint64), g))
            probes = [sum(comb(len(g), d) / (2 if d else 1) for d in range(t + 1)) for t in range(3)]
            # one probe row costs about as much as a thousand comparisons of packed integers
            cost.append([0.0, *(1000.0 * n * p + scale * int(at[: t + 1].sum()) for t, p in enumerate(probes))])
        options.append((*allocate(cost, tau - m + 1), groups))
    _, thresholds, groups = min(options, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


def _squeeze(fp: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(group):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def _keys(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Rows ``(key, own, fp)``: own marks a fingerprint's own key, the others are probes near it.

    Of two fingerprints whose bits of a partition differ, the one of the larger value probes the other's key.
    """

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (group, t) in enumerate(plan):
                value = _squeeze(fp, group)
                for d in range(t + 1):
                    for flips in combinations(range(len(group)), d):
                        mask = np.uint64(sum(1 << f for f in flips))
                        larger = (value ^ mask < value) if d else np.ones(len(fp), bool)
                        key = (value[larger] ^ mask) | (np.uint64(part) << np.uint64(60))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), np.full(len(key), d == 0), fp[larger].view(np.int64))], ["key", "own", "fp"])

    return fps.mapInArrow(run, "key bigint, own boolean, fp bigint")


def _near(x: np.ndarray, y: np.ndarray, tau: int, upper: bool = False):
    """Places in ``x`` and ``y`` of pairs within ``tau`` bits, a tile at a time.

    With ``upper``, ``x`` is the start of ``y``, and each pair comes once or twice.
    """
    rows = max(1, TILE // max(1, len(y)))
    for lo in range(0, len(x), rows):
        start = lo if upper else 0
        hits = np.flatnonzero(np.bitwise_count(x[lo : lo + rows, None] ^ y[start:]) <= tau)
        if len(hits):
            i, j = np.divmod(hits, len(y) - start)
            yield i + lo, j + start


def _pairs(own: np.ndarray, fp: np.ndarray, first: np.ndarray | None, tau: int):
    """Edges that connect all rows of one key within ``tau`` bits; two probes needn't be compared.

    ``first`` is a mask of the first of two blocks, which are compared with each other, else None.
    """
    bits, found, held = fp.view(np.uint64), [], 0
    if first is None:
        rows = np.concatenate([bits[own], bits[~own]])
        sides = [(rows[: int(own.sum())], rows, True)]
    else:
        sides = [(bits[first & own], bits[~first], False), (bits[first & ~own], bits[~first & own], False)]
    for x, y, upper in sides:
        for i, j in _near(x, y, tau, upper):
            far = x[i] != y[j]
            found.append((x[i[far]], y[j[far]]))
            held += len(found[-1][0])
            if held > HELD:
                found = [forest(*map(np.concatenate, zip(*found)))]
                held = len(found[0][0])
    a, b = forest(*map(np.concatenate, zip(*found))) if found else (bits[:0], bits[:0])
    return a.view(np.int64), b.view(np.int64)


def _runs(batches, keys: int, columns: list[str]):
    """Lists of arrays, a run of equal first ``keys`` columns never split; rows come sorted by these."""
    rest = None
    for batch in batches:
        x = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(x[0]):
            continue
        if rest is not None:
            x = [np.concatenate(p) for p in zip(rest, x)]
        last = np.logical_and.reduce([k == k[-1] for k in x[:keys]])
        cut = len(last) - int(last.sum())
        if cut:
            yield [c[:cut] for c in x]
        rest = [c[cut:] for c in x]
    if rest is not None:
        yield rest


def _cut(x: list[np.ndarray], keys: int = 3):
    """Runs of rows of ``x`` that are equal in the first ``keys`` columns."""
    cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in x[:keys]])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(x[0])]):
        yield [c[lo:hi] for c in x]


def _verified(keys: DataFrame, tau: int) -> DataFrame:
    """Rows sorted by (key, p, q) within partitions, compared one run of equal keys at a time."""
    columns = ["key", "p", "q", "mine", "own", "fp"]

    def run(batches):
        for x in _runs(batches, 3, columns):
            edges = [_pairs(own.astype(bool), fp, None if p[0] == q[0] else mine == p[0], tau) for _, p, q, mine, own, fp in _cut(x)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)) for e in zip(*edges)], ["a", "b"])

    return keys.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").select(*columns).mapInArrow(run, "a bigint, b bigint")


def near_links(fps: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints ``fps(fp)`` to edges ``(a, b)`` that connect all within tau bits.

    Keys shared by more than ``block`` fingerprints are dealt out as pairs of blocks, so that no task
    holds more than two blocks; every pair still meets. Only a spanning forest of each comparison
    is emitted, never all pairs of a group.
    """
    n = fps.count()
    rows = fps.orderBy(F.xxhash64("fp")).select("fp").limit(SAMPLE).collect()
    plan = plan_partitions(np.array([r.fp for r in rows], np.int64).view(np.uint64), n, tau)
    keys = written(_keys(fps.select("fp"), plan), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any")
    sizes = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = _in_block_pairs(keys.join(sizes, "key"), F.xxhash64("fp")).select("key", "p", "q", "mine", "own", "fp")
    return _verified(dealt, tau)


def _in_block_pairs(rows: DataFrame, dealt_by: F.Column) -> DataFrame:
    """Rows with ``blocks``, once for each pair of blocks ``(p, q)`` that holds their block ``mine``."""
    rows = rows.withColumn("mine", F.pmod(dealt_by, F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")})


def _roots(nodes: DataFrame, name: str, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, the least ``name`` that links reach; no ids are needed, null or not."""
    roots = connected_components(edges).withColumnRenamed("node", "__node")
    return nodes.join(roots, nodes[name] == roots["__node"], "left").withColumn("root", F.coalesce("root", name)).drop("__node")


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``, the smallest doc_id reachable over links.

    Documents link if their fingerprints differ in ``tau`` bits or fewer. Null, empty and blank texts
    have fingerprint zero and link like any other; repeated rows come out as often as they came in;
    rows with a null doc_id link, but never name a component unless no other id is there; further
    columns are not carried. An empty table gives an empty result.
    """
    marks = written(fingerprints(docs), "fingerprints")
    nodes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    rooted = written(_roots(nodes, "fp", near_links(nodes, tau)), "roots")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return marks.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _marked(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, row, row2, node, text)`` with candidates' fingerprints ``fp`` in place of texts."""
    names = ["doc_id", "row", "row2", "node"]

    def run(batches):
        for b in batches:
            fp = pa.array(fingerprint_batch(b.column("text").to_pylist(), NARROW).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), fp], [*names, "fp"])

    return bounded(docs).mapInArrow(run, f"doc_id {ddl(docs, 'doc_id')}, row bigint, row2 bigint, node bigint, fp bigint")


def _sketch(hashes: np.ndarray) -> bytes:
    """How many hashes lie in each of BUCKETS ranges, 255 at most."""
    return np.minimum(np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """``texts(node, fp, root, text)`` with ``least, size, sketch, shingles`` in place of texts: the distinct hashes of a text's shingles, sorted, as bytes.

    ``least`` is the first of them; blank texts have none.
    """
    names = ["node", "fp", "root"]

    def run(batches):
        for b in batches:
            sets = [np.unique(np.array(_hashes(t, SHINGLE), np.uint64)) for t in b.column("text").to_pylist()]
            least = pa.array([int(x[:1].view(np.int64)[0]) if len(x) else 0 for x in sets], pa.int64())
            more = least, pa.array([len(x) for x in sets], pa.int64()), pa.array([_sketch(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(b.column, names), *more], [*names, "least", "size", "sketch", "shingles"])

    return bounded(texts.select(*names, "text")).mapInArrow(run, "node bigint, fp bigint, root bigint, least bigint, size bigint, sketch binary, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(a) + len(b) - both)


def _counts(sketches: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BUCKETS).astype(np.int16)


def _may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, least: float) -> np.ndarray:
    """Sets that are ``least`` similar differ in so few elements that their counts by bucket can't differ by more."""
    return np.abs(a - b).sum(axis=1) * (1 + least) <= (size_a + size_b) * (1 - least) + 1e-6


def _alike(node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray, cross: np.ndarray | None, tau: int, least: float):
    """Edges that connect all texts within tau bits whose sets are similar; texts connected already aren't compared.

    With ``cross``, a mask of the first of two blocks, only its texts are compared with those of the other.
    """
    found, label, size = [], np.arange(len(node)), np.array([len(x) for x in sets])
    bits = fp.view(np.uint64)
    for i in range(len(node)) if cross is None else np.flatnonzero(cross):
        near = np.bitwise_count(bits ^ bits[i]) <= tau
        near &= np.minimum(size, size[i]) >= least * np.maximum(size, size[i])
        near &= ~cross if cross is not None else np.arange(len(node)) > i
        near = np.flatnonzero(near & (label != label[i]))
        for j in near[_may_link(sketch[near], sketch[i], size[near], size[i], least)] if len(near) else near:
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= least:
                label[label == label[j]] = label[i]
                found.append((node[i], node[j]))
    return forest(*np.array(found, np.int64).reshape(-1, 2).T)


def _compared(dealt: DataFrame, tau: int, least: float) -> DataFrame:
    """Edges between texts of one block, or of the two blocks of a pair: ``dealt(root, p, q, mine, node, fp, sketch, shingles)``."""
    columns = ["root", "p", "q", "mine", "node", "fp", "sketch", "shingles"]

    def run(batches):
        for _, p, q, mine, node, fp, sketch, shingles in (r for x in _runs(batches, 3, columns) for r in _cut(x)):
            a, b = _alike(node, fp, [np.frombuffer(x, np.uint64) for x in shingles], _counts(sketch), None if p[0] == q[0] else mine == p[0], tau, least)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = bounded(dealt).repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").select(*columns)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _undecided(dealt: DataFrame, tau: int, least: float) -> DataFrame:
    """``root, p, q, mine, node`` of texts that may link with one of the other block and aren't connected with it yet."""
    columns = ["root", "p", "q", "mine", "node", "fp", "class", "size", "sketch"]

    def run(batches):
        for x in (r for x in _runs(batches, 3, columns) for r in _cut(x)):
            _, p, _, mine, _, fp, of, size, sketch = x
            sketch = _counts(sketch)
            first, other = np.flatnonzero(mine == p[0]), np.flatnonzero(mine != p[0])
            bits, some = fp.view(np.uint64), np.zeros(len(fp), bool)
            for i, j in _near(bits[first], bits[other], tau):
                i, j = first[i], other[j]
                near = (of[i] != of[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]))
                i, j = i[near], j[near]
                for lo in range(0, len(i), 1 << 16):
                    k, m = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                    near = _may_link(sketch[k], sketch[m], size[k], size[m], least)
                    some[k[near]] = some[m[near]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in x[:5]], columns[:5])

    dealt = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").select(*columns)
    return dealt.mapInArrow(run, "root bigint, p int, q int, mine int, node bigint")


def similar_links(docs: DataFrame, nodes: DataFrame, tau: int = WIDE, least: float = SIMILAR, block: int = TEXTS) -> DataFrame:
    """Edges ``(a, b)`` between texts: fingerprints within ``tau`` bits and shingle sets ``least`` similar.

    ``docs(node, text)`` are texts by their hash, repeats allowed, ``nodes(node, fp)`` each hash once. Texts
    are compared inside the groups that near fingerprints connect, in blocks of about ``block`` texts
    or SET_BYTES; a block gives a spanning forest of its links, so all links connect what they would. Groups of
    several blocks are dealt a second time, by the least shingle first, which most copies share. Then
    all pairs of their blocks are compared by fingerprints and sketches, and sets only of texts that these
    leave in doubt and that aren't connected by then.
    """
    fps = written(nodes.select("fp").distinct(), "fps")
    rooted = written(_roots(fps, "fp", near_links(fps, tau)), "candidates")
    sizes = written(nodes.join(rooted, "fp").groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    members = written(nodes.join(rooted.join(sizes.select("root"), "root"), "fp").select("node", "fp", "root"), "members")
    texts = docs.join(members, "node").dropDuplicates(["node"])  # members are distinct; sets need no join of their own then
    sets = written(_shingle_sets(texts), "shingles")

    def in_blocks(rows: DataFrame, dealt_by: F.Column) -> tuple[DataFrame, DataFrame]:
        blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("size") * 8 / SET_BYTES, F.lit(1.0))).cast("int")
        blocks = written(rows.groupBy("root").agg(blocks.alias("blocks")), "blocks")
        mine = F.pmod(dealt_by, F.col("blocks")).cast("int")
        return blocks, written(_compared(rows.join(blocks, "root").withColumns({"p": mine, "q": mine, "mine": mine}), tau, least), "links")

    blocks, links = in_blocks(sets, F.xxhash64("node"))
    large = blocks.where("blocks > 1")
    if not large.head(1):
        return links
    rows = sets.join(large, "root")
    again = in_blocks(rows.drop("blocks").withColumn("root", F.xxhash64("root", "least")), F.xxhash64("node", F.lit(1)))[1]
    links = links.unionByName(again)
    classes = connected_components(links).select(F.col("node").alias("__node"), F.col("root").alias("class"))
    marks = rows.select("root", "blocks", "node", "fp", "size", "sketch").join(classes, F.col("node") == F.col("__node"), "left")
    marks = written(marks.withColumn("class", F.coalesce("class", "node")).drop("__node"), "classes")
    doubt = written(_undecided(_in_block_pairs(marks, F.xxhash64("node")).where("p < q"), tau, least), "undecided")
    return links.unionByName(_compared(doubt.join(sets.select("node", "fp", "sketch", "shingles"), "node"), tau, least))


def keep_first(docs: DataFrame, tau: int = WIDE, least: float = SIMILAR) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; columns as they came.

    Texts link if their sets of five-word shingles have a Jaccard similarity of ``least`` or more and their
    fingerprints of two-word shingles differ in ``tau`` bits or fewer; a text of fewer words is one shingle,
    null, empty and blank texts link with each other. Groups are what links reach. Rows with a null doc_id
    are dropped if their group has an id, else one of them is kept. Of rows that share the smallest id, the one
    whose hash over all columns is least stays; rows equal in all columns are the same row. A row is known by
    two such hashes. Equal rows are made one by an aggregate, combined before the shuffle, that deals documents as
    the join with the kept rows needs them; kept rows grow with the corpus, so they are never broadcast. The plan
    is the same at every size. An empty table gives an empty result.
    """
    columns = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in docs.dtypes]
    hashes = (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(node.alias("node"), "text")
    marks = written(_marked(docs.select("doc_id", hashes[0].alias("row"), hashes[1].alias("row2"), node.alias("node"), "text")), "fingerprints")
    nodes = written(marks.groupBy("node").agg(F.min("fp").alias("fp")), "nodes")
    rooted = written(_roots(nodes, "node", similar_links(texts, nodes, tau, least)), "roots")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "row2")
    firsts = marks.groupBy("node").agg(F.min(place).alias("first"))
    keep = firsts.join(rooted, "node").groupBy("root").agg(F.min("first").alias("first"))
    row, row2, one = fresh(docs.columns, "row", "row2", "one")
    keep = written(keep.select(F.col("first.row").alias(row), F.col("first.row2").alias(row2)), "kept")
    own = F.first(F.struct(*docs.columns)).alias(one)
    out = docs.withColumns({row: hashes[0], row2: hashes[1]}).groupBy(row, row2).agg(own)
    return out.join(keep.hint("merge"), [row, row2], "left_semi").select(*(F.col(one)[c].alias(c) for c in docs.columns))
