"""Documents in pieces: every cut of a file gives the same elements."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quadrat import table_from_files
from quadrat.sources import elements as el
from quadrat.sources.checks import document_errors
from tests.quadrat.test_files import coco, via


def documents():
    rnd = random.Random(1)
    words = ['a"b', "}{][,:", "\\", "é}", "\\\\}", "", "x\ny"]
    doc = {"info": {"a": [1, {"b": "}"}]}, "n": 3, "images": [], "s": "],[}", "empty": {}, "o": {}, "list": [1, "two, 3", [4, [5]], None]}
    for k in range(40):
        doc["images"].append({"id": k, "name": rnd.choice(words) * rnd.randint(0, 3), "deep": [{"x": [{}, []]}] * rnd.randint(0, 2)})
        doc["o"][f"k{k}{rnd.choice(words)}"] = rnd.choice([{"v": [k]}, k, rnd.choice(words)])
    return [doc, coco([(1, "a.jpg")], [(1, (1, 2, 3, 4), 1)]), via([("k}", "a.jpg", [((1, 2, 3, 4), "1")])])]


def whole(doc):
    out = []
    for name, value in doc.items():
        if isinstance(value, list):
            out += [(name, "[", i, None, x) for i, x in enumerate(value)]
        elif isinstance(value, dict):
            out += [(name, "{", i, k, x) for i, (k, x) in enumerate(value.items())]
    return sorted(out, key=str)


def taken_apart(docs, file_pos=0):
    rows = docs.elements.where(F.col("file_pos") == file_pos).collect()
    return sorted(((r.section, r.kind, r.place, r.key, json.loads(r.value)) for r in rows), key=str)


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    yield lambda size: [spark.conf.set(k, str(size)) for k in names]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split", [None, 64])
def test_every_split_gives_the_same_elements(spark, tmp_path, splits, split):
    if split:
        splits(split)
    every, paths = [(d, i) for d in documents() for i in (None, 1)], []
    for n, (doc, indent) in enumerate(every):
        paths.append(str(tmp_path / f"{n}.json"))
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=indent) + ("\n" if indent else ""))
    docs = el.read_documents(spark, paths)
    skeletons = {r.file_pos: r for r in docs.skeletons.collect()}
    sections = {}
    for r in docs.sections.collect():
        sections.setdefault(r.file_pos, {})[r.section] = r.n
    for n, (doc, _) in enumerate(every):
        assert taken_apart(docs, n) == whole(doc)
        assert json.loads(skeletons[n].skeleton) == {k: 0 if isinstance(v, (list, dict)) else v for k, v in doc.items()} and skeletons[n].bad == 0
        assert sections[n] == {k: len(v) for k, v in doc.items() if isinstance(v, (list, dict))}


def test_summaries_tell_the_state_at_any_cut():
    """Summaries of parts in turn end as one scan of all parts does."""
    for doc in documents():
        raw = json.dumps(doc).encode()
        ends = [k + 1 for k in range(len(raw)) if raw[k : k + 1] == b"}"]
        inside, depth = False, 0
        for lo, hi in zip([0, *ends], ends):
            s, one = el.Summary(inside), el.Summary(False)
            s.add(raw[lo:hi])
            one.add(raw[:hi])
            inside, depth = s.inside, depth + s.depth
            assert (inside, depth) == (one.inside, one.depth)
        cuts = el.Cuts()
        for lo, hi in zip([0, *ends], ends):
            cuts.add(raw[lo:hi])
        got = [(r[2], r[3], r[4], r[5], json.loads(r[6])) for r in cuts.out if r[1] == "element"]
        assert sorted(got, key=str) == whole(doc)


def test_the_last_of_repeated_sections_and_keys_counts(spark):
    text = '{"images": [1, 2, 3], "o": {"a": 1, "b": 2, "a": 3}, "images": [7]}'
    docs = el.of_texts(spark.createDataFrame([(0, "f", text)], "file_pos int, file string, value string"))
    assert taken_apart(docs) == sorted([("images", "[", 0, None, 7), ("o", "{", 0, "a", 3), ("o", "{", 1, "b", 2)], key=str)


NOT_JSON = [
    None, "", "x", "{", '{"images": [1, ]}', '{"images": [,1]}', '{"images": [1 2]}', '{"o": {"a" 1}}', '{"images": [1]', '{"images": [1]}}', '{"images": [{"a": }]}',
    '{"o": {1}}', '{"a": 1', '{"a": {"b": 1}',
]


def test_what_is_not_json(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"f{k}", t) for k, t in enumerate(NOT_JSON)], "file_pos int, file string, value string")
    got = {r.file_pos: r.error for r in document_errors(docs, "COCO").collect()}
    assert got == {k: f"Error decoding JSON data from file: f{k}" for k in range(len(NOT_JSON))}
    paths = []
    for k, t in enumerate(NOT_JSON[1:]):
        paths.append(str(tmp_path / f"{k}.json"))
        (tmp_path / f"{k}.json").write_text(t)
    assert all(r.error.startswith("Error decoding JSON data from file: ") for r in document_errors(el.read_documents(spark, paths), "COCO").collect())


def test_sections_of_the_wrong_type(spark):
    good = coco([(1, "a.jpg")], [(1, (1, 2, 3, 4), 1)])
    texts = [json.dumps(good | {"images": {"a\"b": 1, "c": [2]}}), json.dumps(good | {"annotations": 3}), "[1, 2]", json.dumps(good)]
    docs = spark.createDataFrame([(k, "f", t) for k, t in enumerate(texts)], "file_pos int, file string, value string")
    got = {r.file_pos: r.error for r in document_errors(docs, "COCO").collect()}
    assert got[1] == "3 is not of type 'array'" and got[2] == "[1,2] is not of type 'object'" and got[3] is None
    value, _, message = got[0].partition(" is not of type ")
    assert json.loads(value) == {"a\"b": 1, "c": [2]} and message == "'array'"


def test_one_file_is_many_tasks_work(spark, tmp_path, splits):
    n = 3000
    path = tmp_path / "large.json"
    path.write_text(json.dumps(coco([(k, f"{k:03}.jpg") for k in range(50)], [(k % 50, (k, 1, 2, 3), 1) for k in range(n)])))
    splits(20_000)
    blocks = spark.read.option("lineSep", "}").text(str(path)).select(F.col("_metadata.file_block_start").alias("b")).distinct().count()
    got = table_from_files(spark, str(path), "COCO").orderBy("annotation_id").collect()
    assert blocks > 5 and [(r.annotation_id, r.image_filename, r.image_id, r.x_min) for r in got] == [(k, f"{k % 50:03}.jpg", k % 50, k) for k in range(n)]


def test_whole_texts_are_taken_apart_in_one_pass(spark, tmp_path, monkeypatch):
    """Small texts share batches, nothing is grouped by document, and they give what files give."""
    tables, old = [], el.written
    monkeypatch.setattr(el, "written", lambda df, name: tables.append(name) or old(df, name))
    texts = [json.dumps(d, indent=i) for d in documents() for i in (None, 1)]
    texts += ['{"a": [1, 2], "o": {"x": 1, "x": 2, "y": {}}, "a": {"b": 1, "b": 2}}', "[[1, 2], [3]]", '{"a": "\\"", "b": ["\\\\", "}"]}', '{"a": [1]\\', '{"a": "b', "{}"]
    docs = el.of_texts(spark.createDataFrame([(k, "f", t) for k, t in enumerate(texts)], "file_pos int, file string, value string").coalesce(1))
    assert tables == ["texts", "cut"]
    paths = [tmp_path / f"{k}.json" for k in range(len(texts))]
    for path, text in zip(paths, texts):
        path.write_text(text)
    files = el.read_documents(spark, [str(p) for p in paths])
    for name, columns in (("sections", ("section", "kind", "n")), ("elements", ("section", "kind", "place", "key", "value")), ("every", ("section", "value"))):
        got, want = (sorted(map(repr, getattr(d, name).select("file_pos", *columns).collect())) for d in (docs, files))
        assert got == want, name
    got, want = ({r.file_pos: r.error for r in document_errors(d, "COCO").collect()} for d in (docs, files))
    assert {k: (e or "").split("file: ")[0] for k, e in got.items()} == {k: (e or "").split("file: ")[0] for k, e in want.items()}


def test_via_documents_shuffle_their_lines_once(spark):
    from quadrat.plans.queries import _via_documents

    docs = _via_documents(spark, "/root/testdata/sf0.001")
    assert docs.count() and docs._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
