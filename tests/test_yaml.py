"""Flat YAML documents: values as dumpers write them."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tunelake.functions import yaml as flat
from tunelake.sources import configs

VALUES = [
    ("a: 1 # note", {"a": "1"}),
    ("a: x#y", {"a": "x#y"}),
    ("url: http://x.y/z:1#f # c", {"url": "http://x.y/z:1#f"}),
    ('a: "x\\ny\\t\\"q\\" \\\\ \\x41 \\u00e9 \\U0001F600 \\/ \\e"', {"a": 'x\ny\t"q" \\ A é 😀 / \x1b'}),
    ("a: 'it''s' # c", {"a": "it's"}),
    ("'q': 1\n\"d\\n\": 2\n'it''s': 3", {"q": "1", "d\n": "2", "it's": "3"}),
    ("a: one two three\n  four five\nb: 2", {"a": "one two three four five", "b": "2"}),
    ("a: one\n\n  two\n\n\n  three # c\nb: 2", {"a": "one\ntwo\n\nthree", "b": "2"}),
    ("a: 'one\n  two\n\n  three'\nb: x", {"a": "one two\nthree", "b": "x"}),
    ('a: "one \\\n  \\ two\n  three\\n\n\n  four"\nb: x', {"a": "one  two three\n\nfour", "b": "x"}),
    ("a:\n  value\nb:\n  'quoted\n  on'", {"a": "value", "b": "quoted on"}),
    ("a: # note\n  value", {"a": "value"}),
    ("a:\nb: ~\nc: null\nd: ''\ne: \"\"", {"a": None, "b": None, "c": None, "d": "", "e": ""}),
    ("a: |\n  x\n    y # no comment\n\n  z\nb: >-\n  one\n  two\n\n  three\nc: |-\n  k", {"a": "x\n  y # no comment\n\nz\n", "b": "one two\nthree", "c": "k"}),
    ("a:\n  x: 1\n  y: 2\nb: 1", {"a": None, "b": "1"}),
    ("a:\n- x: 1\n- y\nb: 1", {"a": None, "b": "1"}),
    ("# head\n---\na: 1\n...\n", {"a": "1"}),
    ("\ufeffa: 1\r\nb: '2'\r\n", {"a": "1", "b": "2"}),
    ("a: 'x: y'\nkey with blanks: v\n3b: 4\na:b: 5", {"a": "x: y", "key with blanks": "v", "3b": "4", "a:b": "5"}),
    ("lr: 5e-05\nbf16: true\n", {"lr": "5e-05", "bf16": "true"}),
    ("a: 'k: 1\n\n  b: 2'\nc: 3", {"a": "k: 1\nb: 2", "c": "3"}),
    ("", {}),
]


def test_values(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VALUES)], "i int, t string")
    got = df.select("i", flat.flat_entries(F.col("t")).alias("e"), flat.flat_valid(F.col("t")).alias("ok")).orderBy("i").collect()
    for r, (text, want) in zip(got, VALUES, strict=True):
        assert {e.key: e.value for e in r.e} == want, text
        assert r.ok, text


@pytest.mark.parametrize("text", ['a: "open', "a: 'open\nb: 1", 'a: "x" y', "a: 1\nplain line", "a: b: c", "a: one\n  b: c", "a: @x", "a: 'x'\n  more"])
def test_broken_documents(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(flat.flat_valid(F.col("t"))).first()[0] is False


def test_against_a_dumper(spark):
    yaml = pytest.importorskip("yaml")
    words = ["plain", "it's", "with: colon", "# hash", "a #b", "tab\there", "line\nbreak", "", "null", "3.5", "- dash", "é 😀", "x" * 90, "'", '"', "\\", " lead", "trail "]
    docs = []
    for i in range(60):
        value = " ".join(words[(i * 7 + j * 3) % len(words)] for j in range(i % 25 + 1))
        docs.append({"key": value, f"k {i}": words[i % len(words)], "last": "x"})
    texts = [yaml.dump(d, default_flow_style=False, allow_unicode=bool(i % 2)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", flat.flat_entries(F.col("t")).alias("e"), flat.flat_valid(F.col("t")).alias("ok")).collect():
        assert {e.key: e.value for e in r.e} == docs[r.i], texts[r.i]
        assert r.ok, texts[r.i]


def test_documents_of_one_partition_are_read_by_many_tasks(spark):
    docs = spark.range(40).selectExpr("concat('r', id) AS run", "concat('a: ', id, '\n# c\nb: \"x\"\n') AS content").coalesce(1)
    for read in (configs.config_entries(docs), configs.document_fields(docs, ["a", "b"])):
        used = read.groupBy(F.spark_partition_id()).count().count()
        assert used > 1
    assert rows(configs.config_entries(docs), "run", "key", "value") == sorted(
        x for i in range(40) for x in ((f"r{i}", "a", str(i)), (f"r{i}", "b", "x"))
    )
