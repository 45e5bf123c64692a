"""Fixed schemas: the canonical annotation table, the COCO and VIA documents, and the COCO export."""

from __future__ import annotations

#: Canonical columns, their types, and what stands for "undefined" (None: always defined).
COLUMNS = {
    "annotation_id": ("bigint", None),
    "image_filename": ("string", None),
    "image_id": ("bigint", None),
    "image_width": ("bigint", 0),
    "image_height": ("bigint", 0),
    "x_min": ("double", None),
    "y_min": ("double", None),
    "width": ("double", None),
    "height": ("double", None),
    "supercategory": ("string", ""),
    "category": ("string", ""),
    "category_id": ("bigint", -1),
}
SENTINELS = {c: empty for c, (_, empty) in COLUMNS.items() if empty is not None}

#: Columns and types of the exportable table.
EXPORT_COLUMNS = {
    "annotation_id": "bigint",
    "image_id": "bigint",
    "image_filename": "string",
    "image_width": "bigint",
    "image_height": "bigint",
    "bbox": "array<double>",
    "area": "double",
    "segmentation": "array<array<double>>",
    "category": "string",
    "category_id": "bigint",
    "supercategory": "string",
    "iscrowd": "int",
}

#: Table column to field name in each section of a COCO document.
COCO_FIELDS = {
    "images": {"image_id": "id", "image_filename": "file_name", "image_width": "width", "image_height": "height"},
    "categories": {"category_id": "id", "category": "name", "supercategory": "supercategory"},
    "annotations": {
        "annotation_id": "id", "area": "area", "bbox": "bbox", "image_id": "image_id",
        "category_id": "category_id", "iscrowd": "iscrowd", "segmentation": "segmentation",
    },
}

#: What is read of an element of each section.
ELEMENTS = {
    "images": "struct<id:string,file_name:string,width:variant,height:variant>",
    "annotations": "struct<image_id:string,bbox:array<double>,category_id:bigint>",
    "categories": "struct<id:bigint,name:string,supercategory:string>",
    "_via_img_metadata": "struct<filename:string,file_attributes:map<string,variant>,regions:array<struct<"
    "shape_attributes:struct<x:double,y:double,width:double,height:double>,region_attributes:map<string,string>>>>",
    "_via_attributes": "map<string,struct<options:map<string,string>>>",
}

_ID, _TEXT, _INT, _NUMBER, _OBJECT = (
    {"type": t} for t in (["integer", "string"], ["string"], ["integer"], ["number"], ["object"])
)


def _object(properties: dict | None = None, values: dict | None = None) -> dict:
    return {"type": ["object"], "properties": properties or {}, "values": values}


def _array(items: dict) -> dict:
    return {"type": ["array"], "items": items}


#: The type that each key has if it is there. ``values`` holds for all values of a free-key object.
TYPES = {
    "COCO": _object({
        "info": _OBJECT,
        "licenses": {"type": ["array", "object"]},
        "images": _array(_object({"file_name": _TEXT, "id": _ID, "width": _INT, "height": _INT})),
        "annotations": _array(_object({
            "id": _ID, "image_id": _ID, "bbox": _array(_NUMBER), "category_id": _INT, "area": _NUMBER, "iscrowd": _INT,
        })),
        "categories": _array(_object({"id": _INT, "name": _TEXT, "supercategory": _TEXT})),
    }),
    "VIA": _object({
        "_via_settings": _object({"ui": _OBJECT, "core": _OBJECT, "project": _OBJECT}),
        "_via_img_metadata": _object(values=_object({
            "filename": _TEXT,
            "size": _INT,
            "regions": _array(_object({
                "shape_attributes": _object({"name": _TEXT, "x": _NUMBER, "y": _NUMBER, "width": _NUMBER, "height": _NUMBER}),
                "region_attributes": _OBJECT,
            })),
            "file_attributes": _OBJECT,
        })),
        "_via_image_id_list": _array(_ID),
        "_via_attributes": _object({
            "region": _object(values=_object({"default_options": _OBJECT, "description": _TEXT, "options": _OBJECT, "type": _TEXT})),
            "file": _OBJECT,
        }),
        "_via_data_format_version": _TEXT,
    }),
}

#: Keys that must be there; in objects and arrays of these keys there must be something.
REQUIRED = {
    "COCO": {
        "main": ["images", "annotations", "categories"],
        "images": ["id", "file_name", "width", "height"],
        "annotations": ["id", "image_id", "bbox", "category_id"],
        "categories": ["id", "name"],
    },
    "VIA": {
        "main": ["_via_img_metadata", "_via_attributes"],
        "images": ["filename"],
        "regions": ["shape_attributes"],
        "shape_attributes": ["x", "y", "width", "height"],
    },
}


def property_names(rules: dict, prefix: str = "") -> list[str]:
    """All key paths that the type rules name, sorted, such as ``images/id``."""
    out = []
    for name, rule in (rules.get("properties") or {}).items():
        out += [prefix + name, *property_names(rule, f"{prefix}{name}/")]
    for inner in (rules.get("items"), rules.get("values")):
        out += property_names(inner, prefix) if inner else []
    return sorted(out)


def check_property_names(required: list[str], rules: dict) -> None:
    missing = sorted(set(required) - set(property_names(rules)))
    if missing:
        raise ValueError(f"Required key(s) {missing} not found in schema.")
