"""Feature collections read in splits."""

import json
import random

import pytest

from pipeloom.sources.collections import collection_objects
from pipeloom.sources.geojson import read_features


def features(draw, many):
    nasty = ["plain", 'a "quoted" one', "braces } { }", "back\\slash \\", "\\\"}", "über\n\t  💧", "{", "}", '{"type":"Feature"}', ""]
    return [
        {"type": "Feature", "geometry": draw.choice([None, {"type": "Point", "coordinates": [37.5 + k / 1e4, 55.7]}]), "properties": {"id": k, "object_type": "source", "note": draw.choice(nasty), "more": {"deep": [{"x": draw.choice(nasty)}, {}]}}}
        for k in range(many)
    ]


@pytest.mark.parametrize("indent,limit", [(None, "1k"), (None, "128m"), (2, "700b"), (0, "4k")])
def test_collections_equal_their_features(spark, tmp_path, indent, limit):
    draw, want = random.Random(7), []
    for name, many in (("a", 120), ("b", 1), ("c", 0), ("d", 40), ("d", 9)):
        own = features(draw, many)
        whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn"}}, "features": own, "bbox": [1, 2], "after": {"x": 1}} if name != "b" else {"features": own}
        with (tmp_path / f"{name}.geojson").open("a", encoding="utf-8") as file:  # the last two in one file
            file.write(json.dumps(whole, indent=indent, ensure_ascii=name == "d") + "\n" * (name == "a"))
        want += own
    spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    try:
        got = [json.loads(r.value) for r in collection_objects(spark, str(tmp_path)).collect()]
        split = spark.read.option("lineSep", "}").text(str(tmp_path / "a.geojson")).rdd.getNumPartitions()
        read = read_features(spark, str(tmp_path), kinds=["source"], collection=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda f: json.dumps(f, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert split > 4 or limit == "128m"
    assert len(read) == len(want) and {r.kind for r in read} <= {"source", None}


def test_a_broken_collection_keeps_what_is_whole(spark, tmp_path):
    text = json.dumps({"type": "FeatureCollection", "features": features(random.Random(1), 5)})
    (tmp_path / "x.geojson").write_text(text[: text.rindex('{"type": "Feature"') + 40])
    assert len(collection_objects(spark, str(tmp_path)).collect()) == 4
