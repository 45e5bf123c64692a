"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. A ledger has a row for each pair of
blob and rule version that was scanned, with what was found. A run scans only pairs that the ledger
lacks, each blob once however many paths have it, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import bounded, scratch, written

# The base rules, in the order in which equal starts are listed; then the further ones.
RULES = {
    "assign": (1, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": (1, r"AKIA[A-Z0-9]+"),
    "hex": (1, r"[0-9a-f]{24,}"),
    "pem": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
}
BASE = ("assign", "access", "hex")
_KEPT = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
}
LEDGER = "blob binary, rule string, version int, spans array<array<bigint>>"


def spans(text: str, rule: str) -> list[list[int]]:
    """``[start, end)`` of a rule's matches, leftmost and without overlap, in code points."""
    keep = _KEPT.get(rule, lambda m: True)
    return [list(m.span()) for m in re.finditer(RULES[rule][1], text) if keep(m)]


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` lacks of ``docs(doc_id, text)``; returns ``(paths, new)``, the new rows of the ledger.

    ``paths`` is ``doc_id, blob`` (the 32 bytes of the digest of the text; null counts as empty), narrow and
    written. Only one document of each unseen blob has its text moved and scanned. ``rules`` maps rule
    names to versions (default: all of RULES).
    """
    rules = rules or {k: v for k, (v, _) in RULES.items()}
    docs = docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("own"))
    paths = written(docs.select("doc_id", F.col("own").alias("blob")), "paths")
    have = ledger if ledger is not None else docs.sparkSession.createDataFrame([], LEDGER)
    # an aggregate without Python, so that copies of a blob meet as one row of each task
    first = paths.groupBy("blob").agg(F.min("doc_id").alias("first"))
    seen = have.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
    ask = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).cast("int").alias("version")) for r, v in rules.items()])
    left = F.transform(F.array_except(ask, F.coalesce("seen", F.array().cast(seen.schema["seen"].dataType))), lambda x: x["rule"])
    todo = first.join(seen, "blob", "left").select("blob", "first", left.alias("todo")).where("size(todo) > 0").hint("shuffle_hash")
    kind = "blob binary, rule string, version int, spans array<array<bigint>>"

    def run(batches):
        last = None
        for b in batches:
            rows = []
            for blob, text, names in zip(*(b.column(c).to_pylist() for c in ("blob", "text", "todo"))):
                if blob != last:
                    rows.extend((blob, r, rules[r], spans(text or "", r)) for r in sorted(names))
                last = blob
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.int64()))))],
                ["blob", "rule", "version", "spans"],
            )

    texts = docs.join(todo, (docs["own"] == todo["blob"]) & docs["doc_id"].eqNullSafe(todo["first"])).select("blob", "text", "todo")
    new = written(bounded(texts).mapInArrow(run, kind).dropDuplicates(["blob", "rule", "version"]), "ledger")
    return paths, new


def recorded(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``, None if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit(docs: DataFrame, path: str, rules: dict[str, int] | None = None) -> DataFrame:
    """The paths of one more version of the corpus, after adding what it has of new blobs to the ledger at ``path``."""
    paths, new = update(docs, recorded(docs.sparkSession, path), rules)
    new.write.mode("append").parquet(path)
    return paths


def scan_history(versions: list[DataFrame], path: str | None = None) -> DataFrame:
    """``scan`` of all rows of all versions, committed in turn to the ledger at ``path`` (default: a new one).

    A blob is scanned in the first version that has it; later ones, and later runs with the same ledger,
    only look it up.
    """
    spark = versions[0].sparkSession
    path = path or scratch(spark, "ledger")
    paths = reduce(DataFrame.unionByName, [commit(v, path) for v in versions])
    return _report(findings(paths, recorded(spark, path)))


def findings(paths: DataFrame, ledger: DataFrame, rules: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, blob, found``: all that the ledger has on each path, ``found`` sorted by start and rule.

    ``found`` holds structs ``start, order, rule, end``. A blob with many paths is a hot key of the join:
    its few findings meet every path's row, which adaptive execution may split.
    """
    rules = rules or {k: v for k, (v, _) in RULES.items()}
    order = F.create_map(*[F.lit(x) for k, r in enumerate(RULES) for x in (r, k)])
    version = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    rows = ledger.where(F.col("rule").isin(*rules) & (F.col("version") == version[F.col("rule")]) & (F.size("spans") > 0))
    own = F.transform("spans", lambda s: F.struct(s[0].alias("start"), order[F.col("rule")].alias("order"), F.col("rule").alias("rule"), s[1].alias("end")))
    by_blob = rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("found"))
    by_blob = written(by_blob, "found")
    joined = paths.join(by_blob, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("found", F.array().cast(by_blob.schema["found"].dataType)).alias("found"))


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Counts and spans of secrets in every document, one row each; null and empty texts have none.

    Repeated rows come out as often as they came in, null ids too; further columns are not carried.
    """
    paths, new = update(docs, ledger)
    return _report(findings(paths, new if ledger is None else ledger.unionByName(new)))


def _report(rows: DataFrame) -> DataFrame:
    line = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["rule"].isin(*BASE))
    count = lambda rule: F.size(F.filter("found", lambda x: x["rule"] == rule)).cast("long").alias(f"n_{rule}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
