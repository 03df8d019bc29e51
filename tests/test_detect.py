import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tunelake.functions import detect
from tunelake.operators import catalog
from tunelake.sources import files, registry as registry_io
from tunelake.sources.datasets import scan_folder

ROLE = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
FROM = [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]

CASES = [
    ({"instruction": "q", "output": "a"}, "alpaca", None, None),
    ({"instruction": None, "output": None}, "alpaca", None, None),
    ({"messages": ROLE}, "sharegpt", "messages", "role"),
    ({"messages": FROM}, "sharegpt", "messages", "from"),
    ({"messages": []}, "sharegpt", "messages", None),
    ({"messages": None}, "sharegpt", "messages", None),
    ({"messages": ["x"]}, "sharegpt", "messages", None),
    ({"conversations": ROLE}, "sharegpt", "conversations", "role"),
    ({"conversations": FROM}, "sharegpt", "conversations", "from"),
    ({"conversations": FROM, "messages": ROLE}, "sharegpt", "messages", "role"),
    ({"instruction": "q", "output": "a", "messages": ROLE}, "alpaca", None, None),
    ({"prompt": "q", "completion": "a"}, "alpaca", None, None),
    ({"text": "t"}, "alpaca", None, None),
    ({"prompt": "q"}, None, None, None),
    ({"some_key": "x"}, None, None, None),
    ([1, 2], None, None, None),
    ("text", None, None, None),
]


@pytest.mark.parametrize("record,fmt,key,style", CASES)
def test_classify(spark, record, fmt, key, style):
    df = spark.createDataFrame([(json.dumps(record),)], "record string")
    got = catalog.classify(df).select("format", "message_key", "tag_style").first()
    assert tuple(got) == (fmt, key, style)


def test_strict_json(spark):
    data = [('{"a": 1}', True), ('{"a": 1} {"b": 2}', False), ('{"a": 1}, {"b": 2}', False),
            ("{'a': 1}", False), ('{"a": 1', False), ("", False), ("[1]", False), (' {"a": 1} ', True)]
    df = spark.createDataFrame(data, "t string, ok boolean")
    assert rows(df.filter(detect.single_object(F.col("t")).isNotNull() != F.col("ok"))) == []


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


@pytest.fixture
def folder(tmp_path):
    alpaca = {"instruction": "q", "input": "", "output": "a"}
    chat = {"messages": ROLE}
    write(tmp_path / "array.json", json.dumps([alpaca, alpaca, chat], indent=2))
    write(tmp_path / "bom.json", json.dumps([chat, chat]), "utf-8-sig")
    write(tmp_path / "lines.jsonl", json.dumps(chat) + "\n" + json.dumps(chat) + "\n\n")
    write(tmp_path / "blank_first.jsonl", "\n" + json.dumps(chat) + "\n")
    write(tmp_path / "crlf.jsonl", json.dumps(alpaca) + "\r\n\t\r\n" + json.dumps(alpaca) + "\r\n")
    write(tmp_path / "misnamed.json", json.dumps({"conversations": FROM}) + "\n" + json.dumps({"conversations": FROM}) + "\n")
    write(tmp_path / "object.json", json.dumps(alpaca, indent=1))
    write(tmp_path / "empty.json", "[]")
    write(tmp_path / "scalars.json", "[1, 2]")
    write(tmp_path / "a b+c.jsonl", json.dumps({"text": "t"}) + "\n")
    write(tmp_path / "dataset_info.json", "{}")
    write(tmp_path / "README.txt", "x")
    return tmp_path


def scan(spark, folder):
    return scan_folder(spark, str(folder))


def test_scan_folder(spark, folder):
    got = {r["file_name"]: (r["format"], r["message_key"], r["tag_style"], r["examples"]) for r in scan(spark, folder).collect()}
    assert got == {
        "array.json": ("alpaca", None, None, 3),
        "bom.json": ("sharegpt", "messages", "role", 2),
        "lines.jsonl": ("sharegpt", "messages", "role", 2),
        "blank_first.jsonl": (None, None, None, 1),
        "crlf.jsonl": ("alpaca", None, None, 2),
        "misnamed.json": ("sharegpt", "conversations", "from", 2),
        "object.json": (None, None, None, 1),
        "empty.json": (None, None, None, 0),
        "scalars.json": (None, None, None, 2),
        "a b+c.jsonl": ("alpaca", None, None, 1),
    }


def test_listing_registered_wins_and_stale_goes(spark, folder):
    registry = spark.createDataFrame(
        [("array", "array.json", None, "sharegpt", None, None),
         ("gone", "gone.json", None, "alpaca", None, None),
         ("hub", None, "https://hub.example.org/x", None, None, None),
         ("alias", "lines.jsonl", None, "sharegpt", {"messages": "messages"}, None)],
        catalog.REGISTRY_SCHEMA,
    )
    got = rows(catalog.list_datasets(scan(spark, folder), registry), "name", "format", "source", "examples")
    assert got == sorted([
        ("a b+c", "alpaca", "auto", 1),
        ("alias", "sharegpt", "registered", 2),
        ("array", "sharegpt", "registered", 3),
        ("bom", "sharegpt", "auto", 2),
        ("crlf", "alpaca", "auto", 2),
        ("hub", "alpaca", "registered", 0),
        ("lines", "sharegpt", "auto", 2),
        ("misnamed", "sharegpt", "auto", 2),
    ])


def test_counts_prefer_json_over_jsonl(spark):
    detected = spark.createDataFrame(
        [("d", "d.json", ".json", None, 5), ("d", "d.jsonl", ".jsonl", "alpaca", 9), ("e", "e.jsonl", ".jsonl", "alpaca", 4)],
        "name string, file_name string, extension string, format string, examples bigint",
    )
    assert rows(catalog.count_examples(detected)) == [("d", 5), ("e", 4)]


def test_registry_round_trip(spark, tmp_path, folder):
    entries = catalog.registry_entries(scan(spark, folder))
    body = {r["name"]: json.loads(r["entry"]) for r in registry_io.entry_json(entries).collect()}
    assert body["lines"] == {
        "file_name": "lines.jsonl", "formatting": "sharegpt", "columns": {"messages": "messages"},
        "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user",
                 "assistant_tag": "assistant", "system_tag": "system"},
    }
    write(tmp_path / "dataset_info.json", json.dumps(body))
    back = registry_io.read_registry(spark, str(tmp_path / "dataset_info.json"))
    assert back.count() == len(body) and {r["name"] for r in back.collect()} == set(body)
    write(tmp_path / "broken.json", "{not json")
    assert registry_io.read_registry(spark, str(tmp_path / "broken.json")).count() == 0

    root = str(tmp_path / "versions")
    registry_io.write_version(back, root, 1)
    registry_io.write_version(back.filter("name = 'lines'"), root, 2)
    assert registry_io.read_version(spark, root).count() == 1
    assert registry_io.read_version(spark, root, 1).count() == len(body)


def test_registry_jobs(spark):
    make = lambda data: spark.createDataFrame(data, catalog.REGISTRY_SCHEMA)
    old = make([("a", "a.json", None, "alpaca", None, None), ("b", "b.json", None, "sharegpt", None, None)])
    new = make([("b", "b2.json", None, "sharegpt", {"messages": "messages"}, None), ("c", "c.json", None, "alpaca", None, None)])
    pick = ("name", "file_name")
    assert rows(catalog.upsert(old, new), *pick) == [("a", "a.json"), ("b", "b2.json"), ("c", "c.json")]
    assert rows(catalog.register_absent(old, new), *pick) == [("a", "a.json"), ("b", "b.json"), ("c", "c.json")]
    merged = {r["name"]: r for r in catalog.merge_registries(old, new).collect()}
    assert merged["b"]["file_name"] == "b.json" and merged["b"]["columns"] == {"messages": "messages"}
    assert merged["a"]["columns"] is None
    kept, doomed, unknown = catalog.delete_entries(old, spark.createDataFrame([("b",), ("x",)], "name string"))
    assert rows(kept, "name") == [("a",)] and rows(doomed) == [("b", "b.json")] and rows(unknown) == [("x",)]


def test_download_vote(spark):
    alpaca, odd, chat = '{"instruction": 1, "output": 2}', '{"k": 1}', json.dumps({"conversations": FROM})
    df = spark.createDataFrame(
        [("x", 0, "0.json", odd), ("x", 1, "1.json", chat), ("x", 2, "2.json", alpaca), ("y", 0, "0.json", odd), ("y", 1, "1.json", None)],
        "dataset string, pos int, file_name string, record string",
    )
    got = rows(catalog.download_vote(df), "name", "file_name", "formatting", "message_key", "tag_style")
    assert got == [("x", "1.json", "sharegpt", "conversations", "from"), ("y", "0.json", "alpaca", None, None)]


def test_normalise(spark):
    data = [
        ("r", json.dumps({"messages": ROLE})), ("f", json.dumps({"conversations": FROM})),
        ("c", json.dumps({"messages": [{"who": "me", "says": "hi"}, {"who": "it", "says": "ho"}]})),
        ("a", json.dumps({"instruction": "q", "input": "i", "output": "o"})), ("p", json.dumps({"prompt": "q", "completion": "o"})),
        ("t", json.dumps({"text": "z"})),
    ]
    records = spark.createDataFrame(data, "dataset string, record string")
    registry = spark.createDataFrame(
        [("c", "c.json", None, "sharegpt", {"messages": "messages"},
          {"role_tag": "who", "content_tag": "says", "user_tag": "me", "assistant_tag": "it", "system_tag": "sys"})],
        catalog.REGISTRY_SCHEMA,
    )
    got = {r["dataset"]: [tuple(m) for m in r["messages"]] for r in catalog.normalise(records, registry).collect()}
    assert got == {
        "r": [("user", "a"), ("assistant", "b")], "f": [("user", "a"), ("assistant", "b")],
        "c": [("user", "hi"), ("assistant", "ho")], "a": [("user", "q\ni"), ("assistant", "o")],
        "p": [("user", "q"), ("assistant", "o")], "t": [("text", "z")],
    }


def test_typed_array_and_jsonl_write(spark, tmp_path):
    write(tmp_path / "big.json", json.dumps([{"instruction": "q", "output": str(i)} for i in range(50)], indent=1))
    typed = files.read_typed_array(spark, str(tmp_path / "big.json"), "instruction string, output string")
    assert typed.count() == 50
    records = spark.createDataFrame(
        [("d1", 0, 0, '{"text": "a"}'), ("d2", 0, 1, '{"text": "b"}')], "dataset string, block bigint, pos bigint, record string"
    )
    files.write_jsonl(records, str(tmp_path / "out"))
    assert rows(files.read_lines(spark, str(tmp_path / "out"), recursive=True), "record") == [('{"text": "a"}',), ('{"text": "b"}',)]


def test_manifest_and_missing_files(spark, folder):
    manifest = files.file_manifest(spark, str(folder))
    assert manifest.filter("file_name = 'README.txt'").first()["length"] == 1
    names = [r["file_name"] for r in catalog.data_files(manifest).collect()]
    assert names == sorted(names) and "dataset_info.json" not in names and "README.txt" not in names
    target = spark.createDataFrame([("array.json",)], "file_name string")
    assert "array.json" not in [r["file_name"] for r in catalog.missing_files(manifest, target).collect()]
