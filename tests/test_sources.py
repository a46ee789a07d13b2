"""Readers and writers on files made here."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata import sources as S
from veristrata.sources import archives, html


def test_json_lines_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n", None), (2, None, 0.5)], "b int, a string, c double")
    assert S.write_jsonl(df, f"{tmp_path}/x") == 2
    assert "".join(sorted(open(f).read() for f in map(str, (tmp_path / "x").glob("part-*")))).splitlines()[0].startswith('{"a":')
    assert sorted(map(tuple, S.read_jsonl(spark, f"{tmp_path}/x", "b int, a string, c double").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("line", ["", "[1]", "{bad", "3"])
def test_bad_json_lines_are_errors(spark, tmp_path, line):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n' + line + '\n{"a": 2}\n')
    with pytest.raises(Exception, match="not a JSON object"):
        S.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()


def test_csv_with_line_breaks_and_literals(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,text\n1,\"a\n\"\"b\"\", c\"\n2,\"('un', 'one', [('fra', 1.0)])\"\n3,\"[]\"\n4,\n")
    df = S.read_csv(spark, f"file://{tmp_path}/x.csv")
    assert [r[0] for r in df.orderBy("id").select("text").collect()][:2] == ['a\n"b", c', "('un', 'one', [('fra', 1.0)])"]
    assert [r[0] for r in df.orderBy("id").select(S.scalar(F.col("text"))).collect()] == ['a\n"b", c', "un", "[]", None]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/12.json", "{}")
        z.writestr("d/readme", "no")
    assert [(r.member, r.at, bytes(r.content)) for r in S.read_zip(spark, f"file://{tmp_path}/*.zip", r"d/\d+\.json").collect()] == [("d/12.json", 12, b"{}")]


DUMP = """<mediawiki xmlns="http://x/export-0.11/"><page><title>T</title><ns>0</ns><id>7</id><revision><id>9</id><text>{{Info|a={{b}}}}'''Tea''' is a [[Drink|drink]] ( ) made of leaves&lt;ref&gt;x&lt;/ref&gt;, and it is known in many places of the world .
== More ==
no</text></revision></page><page><title>R</title><ns>0</ns><id>8</id><redirect title="T"/><revision><text>#REDIRECT</text></revision></page></mediawiki>"""


def test_dump_pages(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    rows = S.read_pages(spark, f"file://{tmp_path}/*.xml").orderBy("page_id").collect()
    assert [(r.page_id, r.title, r.namespace, r.redirect) for r in rows] == [("7", "T", 0, False), ("8", "R", 0, True)]
    assert rows[0].lead == "Tea is a drink made of leaves, and it is known in many places of the world." and rows[1].lead == ""
    assert len(list(archives.pages_of(io.BytesIO(DUMP.encode())))) == 2


def test_capped():
    assert archives.capped("One. Two three four.", 12) == "One. Two"
    assert archives.capped("Abcdef. Xyz uvw", 10) == "Abcdef."


def test_pages(spark):
    long = "word " * 30
    page = f"<html><head><title> A  title </title><meta name='description' content='short'></head><nav><p>menu</p></nav><p>one<p>two &amp; {long}</p><script>p('<p>')</script></html>"
    parsed = S.parsed_pages(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    rows = {r.page_id: r for r in S.leads(parsed).collect()}
    assert (rows[1].title, rows[1].description, rows[1].paragraphs) == ("A title", "short", ["one", f"two & {long}".strip()])
    assert rows[1].lead == f"two & {long}".strip() and rows[2].lead is None


def test_passages():
    assert html.passages(["ab", "cd", "x" * 9], 5) == [(0, 5), (6, 11), (11, 15)]
    assert html.passages(["aa bb cc"], 5) == [(0, 2), (3, 8)]
    assert html.passages([]) == []


def test_vectors(spark, tmp_path):
    x = np.arange(12, dtype=np.float16).reshape(4, 3)
    np.save(tmp_path / "v.npy", x)
    rows = S.read_vectors(spark, f"file://{tmp_path}", 3, ["a"] * 4).orderBy("at").collect()
    assert [r.embedding for r in rows] == x.tolist()
    with pytest.raises(ValueError, match="ids"):
        S.read_vectors(spark, f"file://{tmp_path}", 3, ["a"])


def test_splits():
    assert S.splits_of(["a/b/train.jsonl", "a/b/dev.jsonl", "c/test.jsonl", "c/x.jsonl"]) == {"b": {"train": "a/b/train.jsonl", "dev": "a/b/dev.jsonl"}, "c": {"test": "c/test.jsonl"}}
