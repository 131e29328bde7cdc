"""Audit scores of odd texts equal their SQL's."""

import duckdb
import pytest

from lexloom.plans import catalogue

ODD = ["", " ", "\n", "word\n", "a b (c)", "　wide　", "\x0bact\x0b", "mayé", "éACT", "act-act act1 _act act", "clauſe", " ſhall aſhall", "provİso regulatıon", "धारा", "ा" * 3, "\0", "\0\0", "a\x01\x02b", "○○ x", "… word", "日本 😀", "( / / ) / /", "/\x0b/", "Pre-fill.....", ". " * 5, ". " * 5, "(" * 40, "w " * 70 + "(", None]


def documents(tmp_path, rows):
    duck = duckdb.connect()
    duck.sql("create table made (doc_id bigint, text varchar)")
    duck.executemany("insert into made values (?, ?)", rows)
    duck.sql(f"copy made to '{tmp_path}/documents.parquet' (format parquet)")
    duck.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    return duck


@pytest.mark.parametrize("name", ["audit_quality_score", "worst_documents"])
def test_scores_of_odd_texts_equal_their_sql(spark, tmp_path, name):
    # garbled or marked texts of many lengths lie on the borders of rounding
    borders = [text for n in range(60) for text in ("○○" + "x" * n, "(" + "x" * (20 * n), "act " + "x " * (25 * n), "— " * n + "[act]\n")]
    rows = [(k, text) for k, text in enumerate(ODD + borders)]
    duck = documents(tmp_path, rows)
    found = [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(duck.sql(catalogue.oracle_sql()[name]).fetchall())


def test_of_equal_scores_those_without_id_are_last(spark, tmp_path):
    duck = documents(tmp_path, [(k if k % 2 else None, "same") for k in range(24)])
    found = [tuple(r) for r in catalogue.queries()["worst_documents"](spark, str(tmp_path)).collect()]
    assert found == duck.sql(catalogue.oracle_sql()["worst_documents"]).fetchall() and all(uid for uid, _ in found)


def test_long_rows_of_dots_and_blanks_are_scored(spark, tmp_path):
    duck = documents(tmp_path, [(1, ". " * 200_000), (2, "word"), (3, "a" + " " * 100_000 + "/ b"), (4, "(" + " " * 100_000 + "/ / / /")])
    found = [tuple(r) for r in catalogue.queries()["worst_documents"](spark, str(tmp_path)).collect()]
    assert found == duck.sql(catalogue.oracle_sql()["worst_documents"]).fetchall()
