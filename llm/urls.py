"""URL filters: rules by host and path, and for all else a classifier over segmented host names.

Host names are split into words by unigram Viterbi search; a multinomial naive Bayes model scores the
words of host and path, each distinct word by itself. Unigrams are counted over what all pages show,
without markup, scripts and styles. The model learns from the pages that a rule decides, and judges the rest.
"""

from __future__ import annotations

from math import inf, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import written

# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PIECE = 20  # letters of the pieces that are looked up; longer words are found by their first PIECE letters
ALPHA = 0.05
BUCKETS = 1 << 14  # distinct tokens that smoothing takes to exist at least; larger tables count their own


def parts(pages: DataFrame) -> DataFrame:
    """``page_id, url`` and ``host, path``; both are empty for a null url or one without ``://``."""
    at = F.instr("url", "://")
    after = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", 1), upper, upper.lower())
    return pages.select("page_id", "url", host.alias("host"), F.regexp_extract(after, r"^([^/?#]*)([^?#]*)", 2).alias("path"))


def ruled(rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits ``host`` and ``path``, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer rules end up outside
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split into words; an unknown one, of any length, costs more for every letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    sizes, letter = sorted({len(w) for w in counts}), log(10)
    unknown = (-inf, 0)  # the best way to be inside an unknown word, and where it begins
    for e in range(1, len(label) + 1):
        unknown = max((unknown[0] - letter, unknown[1]), (best[e - 1][0] + log(10 / total) - letter, e - 1))
        options = [unknown]
        for size in sizes:
            if size > e:
                break
            if n := counts.get(label[e - size : e]):
                options.append((best[e - size][0] + log(n / total), e - size))
        best.append(max(options))
    out, e = [], len(label)
    while e:
        out.append(label[best[e][1] : e])
        e = best[e][1]
    return out[::-1]


def segments(hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """``host, tokens`` for distinct ``hosts(host)``: the words of all labels, without the last.

    Unigrams stay a table: the pieces of distinct labels are joined with it, so that each label gets only
    the counts of the words that it holds. A word longer than PIECE is looked up by its first letters.
    """
    shown = F.regexp_replace(F.lower(F.coalesce("html", F.lit(""))), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(shown, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    unigrams = written(words.groupBy("word").agg(F.count("*").alias("n")), "unigrams")
    total = unigrams.agg(F.sum("n")).first()[0] or 1
    named = hosts.select("host", F.posexplode(F.regexp_extract_all(F.regexp_replace("host", r"\.?[^.]*$", ""), F.lit("[a-z]+|[^a-z.-]+"), F.lit(0))).alias("at", "label"))
    labels = named.select("label").distinct()
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("s"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("label") - F.col("s") + 1))
    pieces = starts.select("label", "s", F.explode(sizes).alias("size")).select("label", F.substring("label", F.col("s"), F.col("size")).alias("piece"))
    known = unigrams.withColumn("piece", F.substring("word", 1, PIECE))
    held = (F.length("word") <= PIECE) | F.contains("label", F.col("word"))
    found = pieces.join(known, "piece").where(held).select("label", "word", "n").distinct()
    counts = labels.join(found.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts")), "label", "left")

    def run(batches):
        for b in batches:
            got = [segment(x, dict(c or ()), total) for x, c in zip(b.column("label").to_pylist(), b.column("counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(got, pa.list_(pa.string()))], ["label", "words"])

    split = counts.select("label", "counts").mapInArrow(run, "label string, words array<string>")
    own = named.join(split, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    return own.select("host", F.flatten(F.transform("all", lambda x: x["words"])).alias("tokens"))


def naive_bayes(counts: list[tuple[object, bool, int]], pages: dict[bool, int], size: int = BUCKETS) -> tuple[float, dict]:
    """Log odds of blocking: of the classes, and for each token, from ``(token, blocked, n)``; ALPHA smooths.

    The model of few tokens in plain Python; ``weights`` makes the table of any number of them.
    """
    n = {True: {}, False: {}}
    for token, blocked, k in counts:
        n[blocked][token] = n[blocked].get(token, 0) + k
    total = {c: sum(x.values()) + ALPHA * size for c, x in n.items()}
    weight = {t: log((n[True].get(t, 0) + ALPHA) / total[True]) - log((n[False].get(t, 0) + ALPHA) / total[False]) for t in n[True] | n[False]}
    return log((pages.get(True, 0) + 1) / (pages.get(False, 0) + 1)), weight


def weights(tokens: DataFrame) -> DataFrame:
    """``tokens(token, bad)``, a row for each occurrence, to ``(token, weight)`` of all distinct tokens."""
    model = tokens.groupBy("token").agg(F.count_if("bad").alias("block"), F.count_if(~F.col("bad")).alias("allow"))
    model = written(model, "model")
    size, block, allow = model.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    odds = lambda c, n: F.log((F.col(c) + ALPHA) / ((n or 0) + ALPHA * max(BUCKETS, size)))
    return model.select("token", (odds("block", block) - odds("allow", allow)).alias("weight"))


def judged(pages: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score``.

    A rule decides if one fits; else the sign of the log odds of blocking, ``score``, which all pages get. The
    model learns from the pages that a rule decides; ``learn``, a condition on ``host``, leaves some of them out.
    Null urls, and urls without host, have no tokens; the class odds alone decide, as they do for all pages if no
    rule fits any (then 0: allow). Repeated rows and null ids come out as they came in; further columns are not
    carried; empty html counts no words.
    """
    rows = written(parts(pages), "urls")
    hosts = written(segments(rows.select("host").distinct(), pages), "hosts")
    rule, verdict = ruled(rules)
    both = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")).join(hosts, "host", "left")
    own = F.coalesce("tokens", F.array().cast("array<string>"))
    token = F.concat(own, F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))
    both = written(both.select("page_id", "host", "path", "rule", "ruled", token.alias("tokens")), "tokens")
    taught = both.where(F.col("ruled").isNotNull() & (F.lit(True) if learn is None else learn)).withColumn("bad", F.col("ruled") == "block")
    weight = weights(taught.select("bad", F.explode("tokens").alias("token")))
    prior, _ = naive_bayes([], {r["bad"]: r["n"] for r in taught.groupBy("bad").agg(F.count("*").alias("n")).collect()})
    found = both.select("host", "path", "tokens").distinct().select("host", "path", F.explode("tokens").alias("token")).join(weight, "token")
    inorder = F.array_sort(F.collect_list("weight"))  # so that sums don't depend on the order of rows
    sums = written(found.groupBy("host", "path").agg(F.aggregate(inorder, F.lit(0.0), lambda x, y: x + y).alias("sum")), "sums")
    out = both.join(sums, ["host", "path"], "left").withColumn("score", F.lit(prior) + F.coalesce("sum", F.lit(0.0)))
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
