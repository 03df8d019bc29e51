import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tunelake.functions import text as tx
from tunelake.operators import chat, ordered
from tunelake.plans import chat_queries
from tunelake.streaming import reasoning

TEXTS = [
    ("a<think>b</think>c", "ac"), ("a<think>b", "a"), ("a</think>b", "a</think>b"),
    ("<think>a<think>b</think>c</think>d", "c</think>d"), ("x<think>1</think>y<think>2</think>z", "xyz"),
    ("end<thi", "end<thi"), ("<think>a\nb</think>\nc", "\nc"), ("aĠbĊc", "a b\nc"),
    ("<thinkĠ>x", "<think >x"), ("<think>Ġ</think>Ġ", " "), ("", ""), ("<think></think>", ""), ("<<think>x</think>", "<"),
]


def machine(text):
    """Character by character."""
    out, i, inside = [], 0, False
    while i < len(text):
        if not inside and text.startswith("<think>", i):
            inside, i = True, i + 7
        elif inside and text.startswith("</think>", i):
            inside, i = False, i + 8
        else:
            if not inside:
                out.append(text[i])
            i += 1
    return "".join(out).replace("Ċ", "\n").replace("Ġ", " ")


def random_text(rng):
    pieces = ["<think>", "</think>", "<thi", "nk>", "</", "think>", "<", "a", "b\n", "Ġ", "Ċ", ">", "</thin"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))


@pytest.mark.parametrize("text,want", TEXTS)
def test_visible_text(spark, text, want):
    assert machine(text) == want
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tx.visible_text(F.col("text"))).first()[0] == want


def test_visible_text_random(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["v"] for r in df.select("i", tx.visible_text(F.col("text")).alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [machine(t) for t in texts]


@pytest.mark.parametrize("part", [1, 2, 5, 1000])
def test_visible_answers_over_parts(spark, part):
    """Reasoning blocks and tags that lie across tokens and parts."""
    rng = random.Random(part)
    data, want = [], {}
    for conv in range(150):
        text = random_text(rng)
        at, seq = 0, 0
        while at < len(text):
            n = rng.randint(0, 4)
            data.append((conv, 0, seq, text[at : at + n]))
            at, seq = at + n, seq + 1
        if text:
            want[conv] = machine(text)
    rng.shuffle(data)
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, seq bigint, token string")
    got = {}
    for r in chat.visible_answers(df, part).orderBy("conv_id", "part").collect():
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["text"]
    assert got == want


def test_stream_step_does_not_depend_on_chunks():
    rng = random.Random(9)
    for _ in range(2000):
        text = random_text(rng)
        held, inside, out, at = "", False, [], 0
        while at < len(text):
            n = rng.randint(1, 6)
            piece, held, inside = reasoning.advance(held, inside, text[at : at + n])
            out.append(piece)
            at += n
        if not inside:
            out.append(held.translate(reasoning.REPAIR))
        assert "".join(out) == machine(text)


def test_assemble_and_transcripts(spark):
    tokens = spark.createDataFrame(
        [(1, 0, i, f"t{i} ") for i in range(10)], "conv_id bigint, turn bigint, seq bigint, token string"
    ).repartition(5)
    assert rows(chat.assemble(tokens), "part", "text") == [(0, "".join(f"t{i} " for i in range(10)))]
    assert rows(chat.assemble(tokens, 4), "part", "text") == [(0, "t0 t1 t2 t3 "), (1, "t4 t5 t6 t7 "), (2, "t8 t9 ")]
    turns = spark.createDataFrame(
        [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(5)], "conv_id bigint, turn bigint, role string, text string"
    )
    got = chat.transcripts(turns, part_turns=3).orderBy("part").collect()
    assert [[tuple(m) for m in r["messages"]] for r in got] == [
        [("user", "m0"), ("assistant", "m1"), ("user", "m2")], [("assistant", "m3"), ("user", "m4")]
    ]


def test_transcripts_query_gives_whole_conversations(spark, tmp_path):
    """A row holds every turn of its conversation, however many parts it is put together from."""
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}-{t}") for c, n in ((1, 1), (2, 2), (3, 7), (4, 2300)) for t in range(n)]
    odd = [(3, None, "user", "unnumbered"), (3, 3, "user", None), (5, 0, None, "nobody")]
    rows = spark.createDataFrame(turns + odd, "conv_id bigint, turn bigint, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat_queries.transcripts(spark, str(tmp_path)).collect()}
    want = {c: [f"{r}: {x}" for i, _, r, x in turns if i == c] for c in (1, 2, 3, 4)}
    want[3].append("user: unnumbered")
    assert {c: got[c]["transcript"] for c in got} == {c: "\n".join(x) for c, x in want.items()} | {5: None}
    assert {c: (got[c]["part"], got[c]["n"]) for c in got} == {1: (0, 1), 2: (0, 2), 3: (0, 9), 4: (0, 2300), 5: (0, 1)}


@pytest.mark.parametrize("block", [2, 1000])
def test_sessions(spark, block):
    script = ["hi", " ", "a", "/clear", "b", "\t", "/clear ", "c", "/quit", "after", "/clear", "more"]
    data = [(1, i, t) for i, t in enumerate(script)] + [(2, 0, "/exit"), (2, 1, "x"), (3, 5, "only")]
    df = spark.createDataFrame(data, "user_id bigint, seq bigint, text string").withColumn("block", ordered.block_of("seq", block))
    got = rows(chat.sessions(df), "user_id", "session", "seq", "text")
    assert got == sorted([(1, 0, 0, "hi"), (1, 0, 2, "a"), (1, 1, 4, "b"), (1, 2, 7, "c"), (1, 3, 9, "after"), (1, 4, 11, "more"), (2, 1, 1, "x"), (3, 0, 5, "only")])


@pytest.mark.parametrize("block", [2, 1000])
def test_prompt_contexts(spark, block):
    df = spark.createDataFrame(
        [(1, 3, "user", "ab"), (1, 4, "assistant", "cde"), (1, 9, "user", "f"), (2, 0, "user", "z")],
        "conv_id bigint, turn bigint, role string, text string",
    ).withColumn("block", ordered.block_of("turn", block))
    got = rows(chat.prompt_contexts(df), "conv_id", "turn", "context_first_turn", "context_messages", "context_chars")
    assert got == [(1, 3, 3, 1, 2), (1, 4, 3, 2, 5), (1, 9, 3, 3, 6), (2, 0, 0, 1, 1)]
