"""Chat text and session queries."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chat, ordered
from .inputs import load, table, with_inputs
from .named import named

STRIPPED = "regexp_replace(text, '(?s)<think>.*?(?:</think>|\\z)', '', 'g')"
CHUNK = 9


VISIBLE_SQL = with_inputs(
    f"""SELECT conv_id, turn, text FROM (SELECT conv_id, turn, translate({STRIPPED}, 'ĊĠ', CHR(10) || ' ') AS text
      FROM answers) v WHERE text <> ''""",
    "answers",
)


def cut_tokens(rows, with_last=False):
    """Answers cut into small tokens."""
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / CHUNK).cast("bigint")
    cut = rows.select("conv_id", "turn", "text", last.alias("end"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("seq"))
    return cut.select(
        "conv_id",
        "turn",
        "seq",
        F.substr("text", (F.col("seq") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("token"),
        *([(F.col("seq") == F.col("end")).alias("last")] if with_last else []),
    )


#: Small blocks and parts, so that keys of these tables have several of them.
BLOCK = 1000
PART_TOKENS = 8
PART_TURNS = 2


def tokens(spark, sf):
    return cut_tokens(load(spark, sf, "answers"))


def turns(spark, sf):
    return table(spark, sf, "conversations").withColumn("block", ordered.block_of("turn"))


@named("stripped_text", with_inputs(f"SELECT conv_id, turn, {STRIPPED} AS text FROM answers", "answers"))
def stripped_text(spark, sf):
    return load(spark, sf, "answers").select("conv_id", "turn", tx.strip_reasoning(F.col("text")).alias("text"))


@named(
    "repaired_text",
    with_inputs("SELECT conv_id, turn, translate(text, 'ĊĠ', CHR(10) || ' ') AS text FROM answers", "answers"),
)
def repaired_text(spark, sf):
    return load(spark, sf, "answers").select("conv_id", "turn", tx.repair_bpe(F.col("text")).alias("text"))


@named(
    "visible_turns",
    with_inputs(f"SELECT conv_id, turn, translate({STRIPPED}, 'ĊĠ', CHR(10) || ' ') AS text FROM answers", "answers"),
)
def visible_turns(spark, sf):
    return chat.clean_turns(load(spark, sf, "answers"))


@named(
    "assembled_answers",
    with_inputs(
        f"""SELECT conv_id, turn, p AS part, substr(text, CAST(p * {PART_TOKENS * CHUNK} + 1 AS BIGINT), {PART_TOKENS * CHUNK}) AS text
        FROM (SELECT *, unnest(range(CAST((greatest(length(text), 1) - 1) // {PART_TOKENS * CHUNK} + 1 AS BIGINT))) AS p FROM answers) a""",
        "answers",
    ),
)
def assembled_answers(spark, sf):
    return chat.assemble(tokens(spark, sf), PART_TOKENS)


@named(
    "visible_answers",
    with_inputs(
        f"""SELECT conv_id, turn, CAST(0 AS BIGINT) AS part, translate({STRIPPED}, 'ĊĠ', CHR(10) || ' ') AS text
        FROM answers WHERE text <> ''""",
        "answers",
    ),
)
def visible_answers(spark, sf):
    return chat.visible_answers(tokens(spark, sf))


@named(
    "visible_parts",
    with_inputs(
        f"""SELECT conv_id, turn, translate({STRIPPED}, 'ĊĠ', CHR(10) || ' ') AS text FROM answers WHERE text <> ''""", "answers"
    ),
)
def visible_parts(spark, sf):
    """Answers whose blocks span many small parts, put together again."""
    parts = chat.visible_answers(tokens(spark, sf), PART_TOKENS)
    texts = F.sort_array(F.collect_list(F.struct("part", "text")))
    return parts.groupBy("conv_id", "turn").agg(F.array_join(F.transform(texts, lambda p: p["text"]), "").alias("text"))


@named(
    "transcripts",
    """SELECT conv_id, CAST(0 AS BIGINT) AS part, count(*) AS n, string_agg(role || ': ' || text, CHR(10) ORDER BY turn) AS transcript
    FROM conversations GROUP BY conv_id""",
)
def transcripts(spark, sf):
    """Whole conversations, put together from many small parts; turns without a number come last."""
    parts = chat.transcripts(table(spark, sf, "conversations"), part_turns=PART_TURNS)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    ordered_parts = F.sort_array(F.collect_list(F.struct(F.col("part").isNull().alias("unknown"), "part", lines.alias("lines"))))
    said = F.filter(F.flatten(F.transform(ordered_parts, lambda p: p["lines"])), lambda line: line.isNotNull())
    return parts.groupBy("conv_id").agg(
        F.lit(0).cast("bigint").alias("part"),
        F.sum(F.size("messages")).alias("n"),
        F.when(F.size(said) > 0, F.array_join(said, "\n")).alias("transcript"),
    )


SESSIONS = """typed AS (SELECT user_id, seq, trim(text) AS text FROM commands),
  marked AS (SELECT *, CAST(sum(CAST(text IN ('/clear', '/quit', '/exit') AS INT)) OVER w AS BIGINT) AS session
    FROM typed WHERE text <> '' WINDOW w AS (PARTITION BY user_id ORDER BY seq))"""


@named(
    "chat_sessions",
    with_inputs("", "commands").rstrip()
    + f", {SESSIONS} SELECT user_id, session, seq, text FROM marked WHERE text NOT IN ('/clear', '/quit', '/exit')",
)
def chat_sessions(spark, sf):
    rows = load(spark, sf, "commands").withColumn("block", ordered.block_of("seq", BLOCK))
    return chat.sessions(rows).select("user_id", "session", "seq", "text")


@named(
    "prompt_contexts",
    with_inputs("", "commands").rstrip()
    + f""", {SESSIONS} SELECT user_id, session, seq AS turn, 'user' AS role, min(seq) OVER w AS context_first_turn,
    count(*) OVER w AS context_messages, CAST(sum(length(text)) OVER w AS BIGINT) AS context_chars FROM marked
    WHERE text NOT IN ('/clear', '/quit', '/exit') WINDOW w AS (PARTITION BY user_id, session ORDER BY seq)""",
)
def prompt_contexts(spark, sf):
    """What goes with each message of the sessions."""
    commands = load(spark, sf, "commands").withColumn("block", ordered.block_of("seq", BLOCK))
    turns = chat.sessions(commands).withColumnRenamed("seq", "turn").withColumn("role", F.lit("user"))
    return chat.prompt_contexts(turns, ["user_id", "session"])
