import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tunelake.functions import naming, sizes
from tunelake.operators import inventory, search, usage

CACHE = [
    ("models--Qwen--Qwen3-0.6B", "aaa", "model.safetensors", 1024**3),
    ("models--Qwen--Qwen3-0.6B", "bbb", "model-1.safetensors", 2 * 1024**3),
    ("models--Qwen--Qwen3-0.6B", "bbb", "extra.bin", 1024**3 // 2),
    ("models--Qwen--Qwen3-0.6B", "bbb", "notes.bin.txt", 999),
    ("models--a--b--c", "s", "config.json", 10),
    ("models--google--bert", "s", "model.bin", 10),
    ("models--noconfig", "s", "model.bin", 0),
    ("datasets--x--y", "s", "data.bin", 5),
]
CONFIGS = [
    ("models--Qwen--Qwen3-0.6B", "aaa", "config.json", '{"model_type": "llama"}'),
    ("models--Qwen--Qwen3-0.6B", "aaa", "tokenizer_config.json", '{"tokenizer_class": "X"}'),
    ("models--Qwen--Qwen3-0.6B", "bbb", "config.json", '{"model_type": "qwen3"}'),
    ("models--Qwen--Qwen3-0.6B", "bbb", "tokenizer_config.json", '{"a": [1, {"b": null}], "tokenizer_class": "LlamaTokenizerFast"}'),
    ("models--a--b--c", "s", "config.json", '{"model_type": "mistral"}'),
    ("models--a--b--c", "s", "tokenizer_config.json", "{}"),
    ("models--google--bert", "s", "config.json", '{"model_type": "bert"}'),
    ("models--google--bert", "s", "tokenizer_config.json", '{"tokenizer_class": "BertTokenizer"}'),
    ("models--noconfig", "s", "config.json", "broken"),
]


def cache(spark):
    return spark.createDataFrame(CACHE, "entry string, snapshot string, file_name string, length bigint")


def configs(spark):
    return spark.createDataFrame(CONFIGS, "entry string, snapshot string, file_name string, content string")


def test_list_models(spark):
    got = inventory.list_models(cache(spark), inventory.config_types(configs(spark))).collect()
    assert [tuple(r) for r in got] == [
        ("a/b/c", 0.0, "mistral"), ("noconfig", 0.0, "?"), ("Qwen/Qwen3-0.6B", 2.5, "qwen3"),
    ]


def test_text_generation_types(spark):
    kept = ["qwen3", "llama", "mistral", "deepseek", "gemma", "phi", "falcon", "?"]
    dropped = ["bark", "speecht5", "t5", "bert", "roberta", "whisper", "vit", "clip"]
    df = spark.createDataFrame([(t,) for t in kept + dropped], "model_type string")
    assert rows(inventory.text_generation(df)) == sorted((t,) for t in kept)


def test_lookup_and_templates(spark):
    ids = [("QWEN/qwen3-0.6b", "qwen3", "qwen3"), ("A/B/C", "mistral", "mistral"), ("x/DeepSeek-R1-Distill-Qwen", None, "deepseekr1"),
           ("noconfig", None, "qwen3"), ("z/Yi-6B", None, "yi")]
    df = spark.createDataFrame(ids, "repo_id string, type string, want string")
    got = inventory.templates(df, cache(spark), inventory.config_types(configs(spark)))
    assert rows(got, "repo_id", "model_type", "template") == rows(df)


def test_template_cascade(spark):
    cases = {"Qwen/Qwen3-0.6B": "qwen3", "Qwen/Qwen2.5-7B": "qwen2", "Qwen/Qwen-7B": "qwen3", "meta/Llama-3-8B": "llama3", "meta/Llama-4": "llama4",
             "meta/Llama-2-7b": "llama2", "mistralai/Mistral-7B": "mistral", "google/gemma-3-4b": "gemma3", "google/gemma-2-9b": "gemma",
             "google/gemma-7b": "gemma", "deepseek-ai/DeepSeek-R1": "deepseekr1", "deepseek-ai/deepseek-v3": "deepseek3",
             "deepseek-ai/DeepSeek-V2": "deepseek", "deepseek-ai/coder": "deepseek", "microsoft/phi-4": "phi4", "microsoft/phi-2": "phi",
             "tiiuae/falcon": "falcon", "baichuan-inc/x": "baichuan", "internlm/x": "internlm2", "some/unknown": "qwen3"}
    df = spark.createDataFrame(list(cases.items()), "repo_id string, want string")
    got = df.withColumn("t", naming.template(F.col("repo_id"), F.lit(None).cast("string")))
    assert rows(got.filter("t <> want")) == []


def test_tokenizer_audit(spark):
    got = {r["repo_id"]: r for r in inventory.tokenizer_audit(configs(spark)).collect()}
    assert set(got) == {"Qwen/Qwen3-0.6B", "a/b/c"}
    assert got["Qwen/Qwen3-0.6B"]["found"] == "LlamaTokenizerFast"
    assert json.loads(got["Qwen/Qwen3-0.6B"]["corrected"]) == {"a": [1, {"b": None}], "tokenizer_class": "Qwen2TokenizerFast"}
    assert json.loads(got["a/b/c"]["corrected"]) == {"tokenizer_class": "LlamaTokenizerFast"}


def test_adapters_and_chat_options(spark):
    raw = [("saves/r1/lora", '{"base_model_name_or_path": "a/b/c"}'), ("saves/r2/lora", '{"base_model_name_or_path": "a/b/c"}'),
           ("saves/r3/lora", "{}"), ("saves/r4/lora", "broken"), ("saves/r5/lora", '{"base_model_name_or_path": "other/x"}')]
    found = inventory.adapters(spark.createDataFrame(raw, "path string, content string"))
    assert rows(inventory.adapters_by_base(found)) == sorted(
        [("a/b/c", 0, ["saves/r1/lora", "saves/r2/lora"]), ("other/x", 0, ["saves/r5/lora"]), ("unknown", 0, ["saves/r3/lora", "saves/r4/lora"])]
    )
    assert rows(inventory.adapters_by_base(found, per_row=1).filter("base_model = 'a/b/c'"), "part", "paths") == [
        (0, ["saves/r1/lora"]), (1, ["saves/r2/lora"])
    ]
    models = spark.createDataFrame([("a/b/c",), ("z",)], "repo_id string")
    merged = spark.createDataFrame([("m1",)], "name string")
    got = rows(inventory.chat_options(models, found, merged))
    assert got == sorted(
        [("a/b/c", None, "base"), ("a/b/c", "saves/r1/lora", "adapter"), ("a/b/c", "saves/r2/lora", "adapter"), ("m1", None, "merged"), ("z", None, "base")],
        key=lambda t: tuple((x is not None, str(x)) for x in t),
    )


def test_manifest_listings(spark):
    paths = ["/w/saves/r1/lora/adapter_config.json", "/w/saves/r1/lora/x.bin", "/w/models/b/config.json", "/w/models/a/config.json", "/w/models/a/deep/config.json",
             "/c/models--o--n/snapshots/s1/model.bin"]
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, length bigint")
    assert rows(inventory.list_adapters(df, "/w/saves")) == [("r1/lora", "/w/saves/r1/lora")]
    assert [r[0] for r in inventory.list_merged(df, "/w/models").collect()] == ["a", "b"]
    assert rows(inventory.cache_files(df)) == [("models--o--n", "s1", "model.bin", 1)]


def test_search(spark):
    data = [(f"org/M{i:02d}", i, i, ["text-generation"] if i % 2 else None, "text-generation" if i % 5 == 0 else None) for i in range(1, 41)]
    df = spark.createDataFrame(data, "id string, downloads bigint, likes bigint, tags array<string>, pipeline_tag string")
    top = list(reversed(sorted(data, key=lambda r: -r[1])[:20]))
    want = [r[0] for r in top if r[3] or r[4]][:10]
    assert [r["id"] for r in search.search(df, "org/m").orderBy("number").collect()] == want
    plain = [r["id"] for r in search.search(df, "ORG", models_only=False).orderBy("number").collect()]
    assert plain == [r[0] for r in top][:10]
    assert search.search(df, "nothing").count() == 0


def test_sizes(spark):
    cases = [(None, "?", None), (0, "0.0 B", "0 B"), (100, "100.0 B", "100 B"), (1023, "1023.0 B", "1023 B"), (1024, "1.0 KB", "1024 B"),
             (2 * 1024**2, "2.0 MB", "2.0 MB"), (2 * 1024**3, "2.0 GB", "2.00 GB"), (3 * 1024**5, "3.0 PB", "3145728.00 GB"), (1024**4, "1.0 TB", "1024.00 GB")]
    cases += [(n, None, None) for n in (83200, 83225, 1300, 416050, 85_196_800, 1_342_177_280)]

    def long(n):
        for unit in ["B", "KB", "MB", "GB", "TB"]:
            if n < 1024:
                return f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} PB"

    def short(n):
        return f"{n / 1024**3:.2f} GB" if n >= 1024**3 else f"{n / 1024**2:.1f} MB" if n >= 1024**2 else f"{n} B"

    df = spark.createDataFrame([(c[0],) for c in cases], "n bigint")
    got = df.select("n", sizes.size_text(F.col("n")).alias("a"), sizes.short_size_text(F.col("n")).alias("b")).collect()
    for r in got:
        if r["n"] is not None:
            assert (r["a"], r["b"]) == (long(r["n"]), short(r["n"]))
        else:
            assert r["a"] == "?"


def test_usage(spark):
    df = spark.createDataFrame([("data", 5), ("data", None), ("models", 3 * 1024**2), ("other", 1)], "directory string, length bigint")
    got = [tuple(r) for r in usage.workspace_usage(df).collect()]
    assert got == [("data", 2, 5, "5 B"), ("yaml", 0, 0, "0 B"), ("saves", 0, 0, "0 B"), ("models", 1, 3 * 1024**2, "3.0 MB"), ("configs", 0, 0, "0 B")]
    repo = spark.createDataFrame([("a", None), ("a", 2048), ("b", None), ("b", 0)], "repo_id string, length bigint")
    assert rows(usage.download_totals(repo)) == [("a", 2048, "2.0 KB"), ("b", 0, "unknown")]
    assert rows(usage.download_totals(repo, unknown_zero=False), "size") == [("0.0 B",), ("2.0 KB",)]


def test_health(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    docs = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{broken"), ("d", '{"x": 1} {"y": 2}')], "file string, content string")
    health = usage.file_health(expected, docs)
    assert rows(health) == [("a", "valid"), ("b", "corrupted"), ("c", "missing"), ("d", "corrupted")]
    assert rows(usage.health_counts(health)) == [("corrupted", 2), ("missing", 1), ("valid", 1)]


def test_error_kinds(spark):
    cases = [("GatedRepoError", 403, "", "auth"), ("RepositoryNotFoundError", 404, "", "not_found"), ("HTTPError", 401, "", "auth"),
             ("HTTPError", 403, "", "auth"), ("HTTPError", 404, "", "not_found"), ("Timeout", None, "", "network"), ("ConnectionError", None, "", "network"),
             ("OSError", None, "No space left", "disk"), ("OSError", None, "Disk full", "disk"), ("ValueError", None, "disk", "unknown"), ("HTTPError", 500, "boom", "unknown")]
    df = spark.createDataFrame(cases, "exception string, status int, message string, want string")
    assert rows(usage.error_kinds(df).filter("kind <> want")) == []


def test_names(spark):
    cases = [("saves/run/lora", "models/run"), ("saves/run/lora/", "models/run"), ("saves\\run\\lora", "models/saves\\run"), ("x/lora_a/lora", "models/x_a"), ("plain", "models/plain")]
    df = spark.createDataFrame(cases, "path string, want string")
    assert rows(df.withColumn("got", naming.export_name(F.col("path"))).filter("got <> want")) == []
    names = [("a.tar.gz", "a.tar"), (".hidden", ".hidden"), ("noext", "noext"), ("b.json", "b")]
    df = spark.createDataFrame(names, "name string, want string")
    assert rows(df.withColumn("got", naming.stem(F.col("name"))).filter("got <> want")) == []


@pytest.mark.parametrize(
    "config, want",
    [('{"extra":{"tokenizer_class":"Inner"},"tokenizer_class":"LlamaTokenizerFast"}', {"extra": {"tokenizer_class": "Inner"}, "tokenizer_class": "Qwen2TokenizerFast"}),
     ('{"extra":{"tokenizer_class":"Inner"}, "n": 1.5}', {"extra": {"tokenizer_class": "Inner"}, "n": 1.5, "tokenizer_class": "Qwen2TokenizerFast"}),
     ("{}", {"tokenizer_class": "Qwen2TokenizerFast"}), ('{"tokenizer_class": null}', {"tokenizer_class": "Qwen2TokenizerFast"})],
)
def test_audit_sets_the_outer_class_only(spark, config, want):
    files = [("models--a--b", "s1", "config.json", '{"model_type": "qwen2"}'), ("models--a--b", "s1", "tokenizer_config.json", config)]
    got = inventory.tokenizer_audit(spark.createDataFrame(files, "entry string, snapshot string, file_name string, content string")).collect()
    assert [json.loads(r["corrected"]) for r in got] == [want]
