import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from llm import decontaminate, quality
from tests.llm.test_decontaminate import plain
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_groups

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        rows.append(docs.collect())
        if stage is not corpus_pipeline.token_output:
            assert docs.columns == columns
    first, kept, unique, clean, mix, tokens = rows
    said = quality.scored(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in kept} == {r.doc_id for r in said.where("keep").collect()}
    groups = set(plain_groups([(r.doc_id, r.text) for r in kept]).values())
    assert {r.doc_id for r in unique} == groups and len(unique) == len(groups)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    was = {r.doc_id: r.text for r in unique}
    for r in clean:
        n, hit, _ = plain(was[r.doc_id], items)
        assert r.text == was[r.doc_id] if not hit else len(decontaminate.words(r.text)) == n - hit
    size = lambda t: len(t.encode().split())
    sizes, got = {}, {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in mix:
        got[r.source] = got.get(r.source, 0) + size(r.text)
    largest = max(size(r.text) for r in clean)
    assert all(abs(got.get(s, 0) - t) <= largest for s, t in plain_targets(sizes).items())
    plain_tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(mix, key=lambda r: r.doc_id):
        ids = [*plain_tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens) == want
    assert 0 < len(unique) < len(kept) < len(first)


def test_run_repeats_itself(spark):
    out = [corpus_pipeline.run(spark, SF).agg(F.count("*"), F.sum("ids_crc32"), F.max("start")).first() for _ in range(2)]
    assert out[0] == out[1]


def test_stages_on_awkward_rows(spark):
    text = "the words of a text that nobody wrote and that stands here twice " * 3
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", None, 3), (4, text, "en", "s", len(text)), (4, text, "en", "s", len(text)),
            (None, text, "en", "s", len(text)), (5, text + "x", None, "s", None), (6, "long " * 40_000, "en", "t", 200_000), (7, "tied words", "en", "t", 10), (8, "tied words", "en", "t", 10)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["row", "score", "keep", "sampled", "n_words", "spans", "items", "size", "name", "words", "times", "each", "__row", "__n"]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], ", ".join([kind, *(f"`{n}` string" for n in extra)]))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.written(stage(spark, now, SF), name)
            if stage is not corpus_pipeline.token_output:
                assert now.columns == docs.columns
                assert all(r[n] == n for r in now.collect() for n in extra)
        if start is not docs:
            assert now.count() == 0
    unique = corpus_pipeline.simhash_dedup(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in unique) == [1, 4, 6, 7]
