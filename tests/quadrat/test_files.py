"""Readers, checks, numbering, export and ingest on small documents."""

import json
import re

import pytest

from quadrat import from_dense, from_files, maps, table_from_files, to_COCO_file, to_COCO_table
from quadrat.sources.checks import (
    AnnotationsDataset,
    DatasetRules,
    DetectionsDataset,
    check_export,
    check_table,
    checked_input,
    document_errors,
)
from quadrat.sources.documents import read_documents
from quadrat.streaming.ingest import ingest


def coco(images, boxes, categories=((1, "crab", "animal"),), size=(1280, 720)):
    return {
        "images": [{"id": i, "file_name": f, "width": size[0], "height": size[1]} for i, f in images],
        "annotations": [{"id": k, "image_id": i, "bbox": list(b), "category_id": c} for k, (i, b, c) in enumerate(boxes)],
        "categories": [{"id": i, "name": n, **({"supercategory": s} if s is not None else {})} for i, n, s in categories],
    }


def via(entries, options={"1": "crab"}, size=None, attribute="animal"):  # noqa: B006
    files = {"width": str(size[0]), "height": str(size[1])} if size else {}
    return {
        "_via_img_metadata": {
            key: {
                "filename": name, "size": -1, "file_attributes": files,
                "regions": [
                    {
                        "shape_attributes": dict(zip(("name", "x", "y", "width", "height"), ("rect", *b), strict=True)),
                        "region_attributes": {attribute: c} if c else {},
                    }
                    for b, c in boxes
                ],
            }
            for key, name, boxes in entries
        },
        "_via_attributes": {"region": {attribute: {"type": "dropdown", "options": options}} if options else {"x": {"options": {}}}, "file": {}},
    }


@pytest.fixture
def put(tmp_path):
    def write(data, name="a file.json"):
        path = tmp_path / name
        path.write_text(data if isinstance(data, str) else json.dumps(data))
        return str(path)

    return write


def rows(df, *columns):
    columns = columns or df.columns
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


A, B, C = (963.0, 283.0, 302.0, 172.0), (376.0, 314.0, 301.0, 123.0), (458.0, 329.0, 301.0, 131.0)


def test_coco_numbers_count_images_without_boxes_and_keep_gaps(spark, put):
    path = put(coco([(7, "c.jpg"), (5, "a.jpg"), (6, "b.jpg")], [(7, A, 1), (5, B, 1), (7, A, 1), (7, C, 1)]))
    got = table_from_files(spark, path, "COCO")
    assert rows(got, "annotation_id", "image_filename", "image_id", "x_min") == [
        (0, "c.jpg", 2, 963.0), (1, "a.jpg", 0, 376.0), (3, "c.jpg", 2, 458.0),
    ]
    several = table_from_files(spark, [path], "COCO")  # a list numbers anew
    assert rows(several, "annotation_id", "image_filename", "image_id") == [(0, "a.jpg", 0), (1, "c.jpg", 1), (2, "c.jpg", 1)]


def test_coco_repeated_filenames_have_their_own_numbers(spark, put):
    path = put(coco([(1, "a.jpg"), (2, "a.jpg")], [(1, A, 1), (2, B, 1)]))
    assert rows(table_from_files(spark, path, "COCO"), "image_id", "x_min") == [(0, 963.0), (1, 376.0)]


def test_via_repeated_filenames_share_the_first_number(spark, put):
    path = put(via([("k2", "b.jpg", [(A, "1")]), ("k1", "a.jpg", [(B, "1")]), ("k0", "a.jpg", [(C, "1")]), ("k3", "z.jpg", [])]))
    got = table_from_files(spark, path, "VIA")
    assert rows(got, "annotation_id", "image_filename", "image_id") == [(0, "b.jpg", 2), (1, "a.jpg", 0), (2, "a.jpg", 0)]


def test_via_repeated_key_counts_once_by_its_last_entry(spark, put):
    text = json.dumps(via([("k", "a.jpg", [(A, "1")]), ("j", "b.jpg", [(B, "1")]), ("K", "c.jpg", [(C, "1")])]))
    got = table_from_files(spark, put(text.replace('"K"', '"k"')), "VIA")
    assert rows(got, "annotation_id", "image_filename", "x_min") == [(0, "c.jpg", 458.0), (1, "b.jpg", 376.0)]


def test_via_map_order_holds_for_many_keys(spark, put):
    names = [f"{(k * 37) % 101:03d}" for k in range(101)]
    got = table_from_files(spark, put(via([(n, f"{n}.jpg", [(A, "1")]) for n in names])), "VIA")
    assert [r[1] for r in rows(got, "annotation_id", "image_filename")] == [f"{n}.jpg" for n in names]


@pytest.mark.parametrize(
    "options, key, want",
    [({"1": "crab"}, "1", ("animal", "crab", 1)), ({"fish": "f", "crab": "c"}, "crab", ("animal", "c", 1)), ({"1": "crab"}, None, ("", "", -1))],
)
def test_via_categories(spark, put, options, key, want):
    got = table_from_files(spark, put(via([("k", "a.jpg", [(A, key)])], options)), "VIA")
    assert rows(got, "supercategory", "category", "category_id") == [want]


@pytest.mark.parametrize("value, want", [(100, 100), ("100", 100), ("p", 0), (None, 0)])
def test_via_image_sizes(spark, put, value, want):
    doc = via([("k", "a.jpg", [(A, "1")])])
    if value is not None:
        doc["_via_img_metadata"]["k"]["file_attributes"]["width"] = value
    assert rows(table_from_files(spark, put(doc), "VIA"), "image_width", "image_height") == [(want, 0)]


def test_both_formats_give_the_same_table(spark, put):
    one = put(via([("k1", "b.jpg", [(A, "1"), (B, "1")]), ("k2", "a.jpg", [(C, "1")])], size=(1280, 720)), "v.json")
    two = put(coco([(1, "b.jpg"), (2, "a.jpg")], [(1, A, 1), (1, B, 1), (2, C, 1)]), "c.json")
    assert rows(table_from_files(spark, one, "VIA")) == rows(table_from_files(spark, two, "COCO"))


def test_files_merge_by_filename_and_keep_the_first_of_equal_rows(spark, put):
    one = put(coco([(1, "b.jpg"), (2, "c.jpg")], [(1, A, 1), (2, B, 1)]), "one file.json")
    two = put(coco([(9, "a.jpg"), (8, "b.jpg")], [(8, A, 1), (9, C, 1)]), "two.json")
    ds = from_files([one, two, one], "COCO", images_dirs="pictures", spark=spark)
    assert rows(ds.annotations, "annotation_id", "image_filename", "image_id", "id") == [(0, "a.jpg", 0, 0), (1, "b.jpg", 1, 0), (2, "c.jpg", 2, 0)]
    assert rows(ds.images, "image_id", "image_filename") == [(0, "a.jpg"), (1, "b.jpg"), (2, "c.jpg")]
    assert rows(ds.categories, "category_id", "category") == [(1, "crab")]
    assert ds.attrs["annotation_files"] == [one, two, one] and ds.attrs["images_directories"] == "pictures"


def test_category_names_of_one_id_the_last_counts(spark, put):
    one = put(coco([(1, "a.jpg")], [(1, A, 1)]), "1.json")
    two = put(coco([(1, "b.jpg")], [(1, A, 1)], [(1, "lobster", "animal")]), "2.json")
    boxes = table_from_files(spark, [one, two], "COCO")
    assert rows(maps(boxes)[1], "category_id", "category") == [(1, "lobster")] and boxes.count() == 2


def test_one_image_with_two_sizes_is_named(spark, put):
    one = put(coco([(1, "a.jpg")], [(1, A, 1)]), "1.json")
    two = put(coco([(1, "a.jpg")], [(1, B, 1)], size=(10, 10)), "2.json")
    with pytest.raises(ValueError, match="a.jpg"):
        from_files([one, two], "COCO", spark=spark)


def test_dense_view_pads_and_comes_back(spark, put):
    path = put(coco([(1, "a.jpg"), (2, "b.jpg"), (3, "c.jpg")], [(1, A, 1), (2, B, 1), (2, C, 1)]))
    ds = from_files(path, "COCO", spark=spark)
    wide = ds.dense().orderBy("image_id").collect()
    assert [r["image_id"] for r in wide] == [0, 1]  # c.jpg has no boxes
    assert wide[0]["position_x"][0] == 963 + 151 and wide[0]["position_x"][1] != wide[0]["position_x"][1]
    assert wide[0]["category"] == [1, -1] and wide[0]["image_shape"] == [1280, 720]
    back = from_dense(ds.dense(), ds.images, ds.categories)
    columns = ("image_id", "id", "image_filename", "x_min", "y_min", "width", "height", "category")
    assert rows(back.annotations, *columns) == rows(ds.annotations, *columns)
    AnnotationsDataset(back)


def test_export_and_reload(spark, put, tmp_path):
    path = put(coco([(1, "00000.jpg"), (2, "00083.jpg"), (3, "00166.jpg")], [(1, A, 1), (2, B, 1), (3, C, 1), (3, A, 2)], [(1, "crab", "animal"), (2, "eel", None)]))
    ds = from_files(path, "COCO", spark=spark)
    table = to_COCO_table(ds)
    first = table.orderBy("annotation_id").first()
    assert first["area"] == 51944 and first["segmentation"] == [[963, 283, 1265, 283, 1265, 455, 963, 455]]
    out = to_COCO_file(ds, str(tmp_path / "out.json"))
    doc = json.load(open(out))
    assert list(doc) == sorted(doc) and list(doc["annotations"][0]) == sorted(doc["annotations"][0])
    assert [a["id"] for a in doc["annotations"]] == [0, 1, 2, 3] and {a["iscrowd"] for a in doc["annotations"]} == {0}
    assert doc["categories"] == [{"id": 1, "name": "crab", "supercategory": "animal"}, {"id": 2, "name": "eel", "supercategory": ""}]
    again = from_files(out, "COCO", spark=spark)
    columns = [c for c in ds.annotations.columns if c != "annotation_id"]
    assert rows(again.annotations, *columns) == rows(ds.annotations, *columns)


def test_export_fills_what_is_absent(spark, put):
    ds = from_files(put(coco([(1, "a.jpg")], [(1, A, 1)], [(1, "crab", None)], (0, 0))), "COCO", spark=spark)
    assert "supercategory" not in ds.annotations.columns and "image_width" not in ds.annotations.columns
    row = to_COCO_table(ds).first()
    assert (row["supercategory"], row["image_width"], row["category"]) == ("", 0, "crab")


def test_file_without_categories(spark, put):
    path = put(via([("k", "a.jpg", [(A, None)])], None))
    assert rows(table_from_files(spark, path, "VIA"), "category", "category_id") == [("", -1)]
    with pytest.raises(ValueError, match=r"Missing required data variables: \['category'\]"):
        from_files(path, "VIA", spark=spark)


GOOD = coco([(1, "a.jpg")], [(1, A, 1)])


def changed(section, **values):
    doc = json.loads(json.dumps(GOOD))
    doc[section][0] |= values
    return doc


BAD = [
    ("COCO", "just-a-string", "Error decoding JSON data from file"),
    ("COCO", GOOD | {"annotations": [1, 2, 3]}, "1 is not of type 'object'"),
    ("COCO", changed("annotations", category_id=None), "null is not of type 'integer'"),
    ("COCO", changed("annotations", category_id="1"), "is not of type 'integer'"),
    ("COCO", changed("annotations", bbox=[1, 2, "3", 4]), "is not of type 'number'"),
    ("COCO", {"images": GOOD["images"]}, r"Required key\(s\) \['annotations', 'categories'\] not found\."),
    ("COCO", GOOD | {"annotations": [], "categories": []}, r"Empty value\(s\) found for the required key\(s\) \['annotations', 'categories'\]\."),
    ("COCO", GOOD | {"images": [{"id": 1, "width": 1, "height": 1}]}, r"Required key\(s\) \['file_name'\] not found for image "),
    ("COCO", GOOD | {"images": GOOD["images"] * 4}, "There are 4 image entries, but only 1 unique image IDs"),
    ("VIA", {"_via_img_metadata": {}}, r"Required key\(s\) \['_via_attributes'\] not found"),
    ("VIA", via([]), r"Empty value\(s\) found for the required key\(s\) \['_via_img_metadata'\]"),
    ("VIA", via([("k", "a.jpg", [((1, 2, "49", 4), "1")])]), "\"49\" is not of type 'number'"),
]


@pytest.mark.parametrize("format", ["COCO", "VIA"])
def test_bad_documents(spark, put, format):
    """All in one read; the first of them is the one that loading raises."""
    some = [(doc, message) for f, doc, message in BAD if f == format]
    paths = [put(doc, f"{k}.json") for k, (doc, _) in enumerate(some)]
    got = {r.file_pos: r.error for r in document_errors(read_documents(spark, paths), format).collect()}
    for k, (_, message) in enumerate(some):
        assert re.search(message, got[k]), (k, got[k])
    with pytest.raises(ValueError, match=some[0][1]):
        table_from_files(spark, paths[0], format)


def test_unknown_format(spark, put):
    with pytest.raises(ValueError, match="Unsupported format: BAD"):
        table_from_files(spark, put(GOOD), "BAD")


def test_via_region_without_a_side_is_named(spark, put):
    doc = via([("k", "a.jpg", [(A, "1"), (B, "1")])])
    del doc["_via_img_metadata"]["k"]["regions"][1]["shape_attributes"]["width"]
    with pytest.raises(ValueError, match=r"Required key\(s\) \['width'\] not found for region 1 under k\."):
        table_from_files(spark, put(doc), "VIA")


def test_unknown_image_of_an_annotation(spark, put):
    with pytest.raises(Exception, match="No image with id 5"):
        table_from_files(spark, put(coco([(1, "a.jpg")], [(5, A, 1)])), "COCO")


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        table_from_files(spark, str(tmp_path / "none.json"), "COCO")


def test_table_rules(spark, put):
    ds = from_files(put(GOOD), "COCO", spark=spark)
    with pytest.raises(ValueError, match="Missing column"):
        check_table(ds.annotations.drop("x_min"))
    with pytest.raises(ValueError, match="must be double"):
        check_table(ds.annotations.selectExpr("* except (x_min)", "cast(x_min as int) as x_min"))
    with pytest.raises(ValueError, match="area"):
        check_export(to_COCO_table(ds).selectExpr("* except (area)", "-area as area"))


def test_dataset_rules(spark, put):
    ds = from_files(put(GOOD), "COCO", spark=spark)
    with pytest.raises(TypeError, match="Expected a Dataset"):
        AnnotationsDataset([1])
    with pytest.raises(ValueError, match=r"Missing required data variables: \['confidence'\]"):
        DetectionsDataset(ds)
    DetectionsDataset(type(ds)(ds.annotations.selectExpr("*", "0.5 as confidence"), ds.images, ds.categories))
    with pytest.raises(ValueError, match=r"Missing required dimensions: \['id'\]"):
        AnnotationsDataset(type(ds)(ds.annotations.drop("id"), ds.images, ds.categories))
    with pytest.raises(TypeError, match="required_dims"):
        type("Bad", (DatasetRules,), {"required_data_vars": {}})

    @checked_input(AnnotationsDataset)
    def f(dataset):
        return 1

    assert f(ds) == f(dataset=ds) == 1
    with pytest.raises(TypeError):
        f(dataset=3)


def test_ingest_takes_new_files_once_and_sets_bad_ones_aside(spark, put, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(GOOD))
    (folder / "bad.json").write_text("{")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    ingest(spark, str(folder), "COCO", out, mark, available_now=True).awaitTermination()
    (folder / "b.json").write_text(json.dumps(coco([(1, "b.jpg")], [(1, B, 1), (1, C, 1)])))
    ingest(spark, str(folder), "COCO", out, mark, available_now=True).awaitTermination()
    assert rows(spark.read.parquet(out), "image_filename", "x_min") == [("a.jpg", 963.0), ("b.jpg", 376.0), ("b.jpg", 458.0)]
    assert spark.read.parquet(f"{out}_errors").count() == 1
