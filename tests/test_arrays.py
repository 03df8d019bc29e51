"""Splittable scans of JSON documents against whole-document reads."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.operators import catalog
from tunelake.sources import arrays, files
from tunelake.sources.datasets import scan_folder

RECORDS = [
    {"instruction": "a, b [c] {d} \"e\" \\", "output": None},
    {"messages": [{"role": "user", "content": "x\\\"],[\né中,"}]},
    {"text": "", "deep": [[[1, 2], [3, {"k": "],"}]], []]},
    {"text": None},
    [1, 2, [3]],
    "plain, text",
    17,
    None,
    True,
    {"payload": "\\\\"},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("arrays")
    rng = np.random.default_rng(0)
    many = [RECORDS[int(i)] for i in rng.integers(len(RECORDS), size=400)]
    texts = {
        "plain.json": json.dumps(many),
        "pretty.json": json.dumps(many, indent=2, ensure_ascii=False),
        "tight.json": json.dumps(many, separators=(",", ":")),
        "bom.json": "﻿  " + json.dumps(many[:50]) + "\n\n",
        "empty.json": "",
        "blank.json": " \n ",
        "no_items.json": " [ \n ] ",
        "one.json": '[{"text": "only"}]',
        "object.json": json.dumps({"a": many}),
        "two_objects.json": json.dumps({"a": many[:9]}) + "\n" + json.dumps({"b": [1, 2]}),
        "lines.json": "\n".join(json.dumps(x) for x in many) + "\n",
        "crlf.json": "\r\n".join(json.dumps(x) for x in many[:40]),
        "two_arrays.json": json.dumps(many[:30]) + json.dumps(many[:3]),
        "trailing.json": json.dumps(many[:30]) + " x, y",
        "comma_end.json": json.dumps(many[:30])[:-1] + ", ]",
        "comma_start.json": "[," + json.dumps(many[:30])[1:],
        "comma_twice.json": json.dumps(many[:30])[:-1] + ",, 1]",
        "cut_off.json": json.dumps(many)[:-3],
        "open_string.json": '["a, b, c',
        "mixed_up.json": '[{"a": [1, 2}, 3]]',
        "bare_words.json": "[a, b, c]",
        "scalar.json": "17",
        "commas.json": ",,a,\n,",
    }
    for name, text in texts.items():
        (path / name).write_bytes(text.encode())
    return str(path)


def _plain(spark, folder):
    docs = files.read_json_documents(spark, folder)
    return {
        r.file: (r.shape, r.records)
        for r in catalog.document_records(docs).groupBy("file", "shape")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "record"))).alias("p"))
        .select("file", "shape", F.transform("p", lambda x: x["record"]).alias("records")).collect()
    }


@pytest.mark.parametrize("size, split", [(arrays.CHUNK, "128m"), (300, "128m"), (40, "700"), (1, "2k")])
def test_records_of_documents_in_many_chunks(spark, folder, size, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split != "128m" else "4m")
    try:
        rows = arrays.document_records(spark, folder, size=size)
        got = {
            r.file: (r.shape, [x.record for x in r.p])
            for r in rows.groupBy("file", "shape").agg(F.sort_array(F.collect_list(F.struct("block", "pos", "record"))).alias("p")).collect()
        }
        heads = {r.file: (r.shape, r.record, r.examples) for r in arrays.document_heads(spark, folder, size=size).collect()}
        scanned = {r.file: (r.format, r.message_key, r.tag_style, r.examples) for r in scan_folder(spark, folder).collect()}
        if split == "700":
            assert arrays.read_chunks(spark, folder, size=size).filter("file LIKE '%/plain.json'").select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = _plain(spark, folder)
    for file, (shape, records) in want.items():
        if file.endswith(("/empty.json", "/commas.json")):
            continue  # no chunk, or a comma at the very end that the reader takes for a separator
        assert got[file] == (shape, records), file
        filled = [x for x in records if shape != "lines" or (x or "").strip()]
        assert heads[file] == (shape, None if shape == "object" else records[0], len(filled)), file
    assert set(got) - set(want) == set()
    docs = files.read_json_documents(spark, folder)
    for r in catalog.detect_documents(docs).collect():
        if not r.file.endswith("/commas.json"):
            assert scanned[r.file] == (r.format, r.message_key, r.tag_style, r.examples), r.file
