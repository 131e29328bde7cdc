import json

import pytest

from lexloom.operators import parse
from lexloom.sources import files


def test_raw_json_to_nodes(spark, tmp_path):
    doc = {"kids": [{"type": "heading", "content": "CHAPTER I", "page number": 1}, {"type": "paragraph", "content": "2. Definitions.--In this Act", "page number": 1}]}
    (tmp_path / "Companies_Act.json").write_text(json.dumps(doc))
    (tmp_path / "rules.json").write_text(json.dumps({"kids": []}))
    raw = files.raw_json(spark, str(tmp_path))
    one = files.matching(raw, ["act"])
    assert [r["source_pdf"] for r in one.collect()] == ["Companies_Act"]
    nodes = parse.parse_act(parse.flatten_elements(one))
    files.write_nodes(nodes, f"{tmp_path}/nodes")
    back = spark.read.parquet(f"{tmp_path}/nodes")
    assert {r["uid"] for r in back.where("label = 'Section'").collect()} == {"sec-2"}


def test_missing_root_and_bad_rows_are_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    with pytest.raises(Exception, match="no kids"):
        files.raw_json(spark, f"{tmp_path}/a.json").collect()
    (tmp_path / "b.json").write_text('{"uid": {"x": 1}}\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        files.parsed(spark, f"{tmp_path}/b.json", "uid int").collect()


def test_missing_parsed_file_tells_the_others(spark, tmp_path):
    (tmp_path / "one.json").write_text("{}")
    with pytest.raises(FileNotFoundError, match="available: one.json"):
        files.parsed(spark, f"{tmp_path}/two.json", "uid int")


def test_entry_without_the_training_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lexloom", tmp_path / "lexloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [k for k in q if k.startswith('op1_')] and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
