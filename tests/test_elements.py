import json
import random

import pytest

from lexloom.operators import parse
from lexloom.sources import files
from lexloom.sources.elements import elements


def made(rng, depth=0):
    text = "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", "é", "\n", " ", ","]) for _ in range(rng.randint(0, 12)))
    out = {"type": rng.choice(["paragraph", "heading", "list", "table"]), "content": text, "page number": rng.randint(1, 9), "kids": []}
    if depth < 3 and rng.random() < 0.5:
        out["kids"] = [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
        if out["type"] == "list":
            out["list items"] = [made(rng, depth + 1) for _ in range(2)]
    return out


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_files_of_many_partitions(spark, tmp_path, indent, split):
    rng = random.Random(indent or 0)
    docs = {
        "one": {"kids": [made(rng) for _ in range(60)]}, "two": {"meta": {"kids of": [{"a": 1}, {"b": {"c": {}}}]}, "title": 'a "kids": [ {', "kids": [made(rng) for _ in range(25)], "more": {"x": {"y": [{"z": {}}]}}, "end": [[{}]]},
        "none": {"kids": []}, "last": {"kids": [], "x": {"y": {"z": 1}}}, "flat": {"kids": [{"type": "paragraph", "content": "x"}]},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=name != "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = elements(spark, str(tmp_path)).collect()
        found = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            found.setdefault(r["source_pdf"], []).append(json.loads(r["element"]))
        assert found == {k: v["kids"] for k, v in docs.items() if v["kids"]}
        flat = lambda raw: sorted(tuple(r)[:1] + tuple(r)[2:] for r in parse.flatten_elements(raw).collect())
        if split != 64:
            assert flat(elements(spark, str(tmp_path))) == flat(files.raw_json(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_file_without_kids_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "\\"kids\\": [", "x": {"kids": [{"a": 1}]}}')
    with pytest.raises(Exception, match="no kids in a.json"):
        elements(spark, str(tmp_path)).collect()
