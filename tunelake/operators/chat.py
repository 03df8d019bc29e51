"""Chat text, transcripts and sessions.

Tokens are rows (conv_id, turn, seq, token), turns are rows (conv_id, turn, role, text) and
commands are rows (user_id, block, seq, text). One answer or conversation may be larger than a
row can hold, so assembled text and transcripts come in parts: part 0 is the whole of any
ordinary one, and the parts in order are the whole of a large one.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.constants import CLEAR_COMMAND, QUIT_COMMANDS, THINK_CLOSE, THINK_OPEN
from ..functions.detect import strip_space
from . import ordered

PART_TOKENS = 1 << 16
PART_TURNS = 1 << 10
ANSWER = ("conv_id", "turn")


def assemble(tokens: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Token text in arrival order, as rows (conv_id, turn, part, text)."""
    return (
        tokens.withColumn("part", ordered.block_of("seq", part_tokens))
        .groupBy(*ANSWER, "part")
        .agg(F.expr("listagg(token, '') WITHIN GROUP (ORDER BY seq)").alias("text"))
    )


def _part_edges(parts: DataFrame) -> DataFrame:
    """What a part must know of its neighbours; only parts for which there is anything.

    Works on a few characters per part: its first and last ones and its last whole tag.
    `carry_in` and `carry_out` are the starts of a tag that end the text before the part and
    the part itself; `starts_inside` says that a block is open when the part begins.
    """
    edge = len(THINK_CLOSE) - 1
    by_part = Window.partitionBy(*ANSWER).orderBy("part")
    short = parts.select(
        *ANSWER,
        "part",
        F.left("text", F.lit(edge)).alias("head"),
        F.right("text", F.lit(edge)).alias("end"),
        tx.ends_in_reasoning(F.col("text")).alias("tag"),
    )
    seen = short.withColumn(
        "before", F.array_join(F.collect_list("end").over(by_part.rowsBetween(-edge, -1)), "")
    ).withColumn("more", F.lead("part").over(by_part).isNotNull())
    carried = seen.select(
        *ANSWER,
        "part",
        tx.partial_tag(F.col("before")).alias("carry_in"),
        F.when(F.col("more"), tx.partial_tag(F.concat("before", "end"))).otherwise("").alias("carry_out"),
        "head",
        "tag",
    )
    # a tag may be completed by the first characters of the part
    tag = F.coalesce("tag", tx.ends_in_reasoning(F.concat("carry_in", "head")))
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(F.col("tag"), ignorenulls=True).over(earlier), F.lit(False))
    return (
        carried.withColumn("tag", tag)
        .select(*ANSWER, "part", "carry_in", "carry_out", inside.alias("starts_inside"))
        .filter((F.col("carry_in") != "") | (F.col("carry_out") != "") | F.col("starts_inside"))
    )


def visible_answers(tokens: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Assembled answers without reasoning blocks and with repaired characters.

    A block may span parts. The end of a part that could be the start of a tag moves to the
    next part, so no tag is cut; then a part begins inside a block exactly if the last whole
    tag before it is an opening one. An answer of one part has no edges and joins nothing.
    """
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("seq").isNotNull()
    # filtered once here, so that both uses below read the same shuffle
    parts = assemble(tokens.filter((F.col("token") != "") & known), part_tokens).filter(
        F.col("part").isNotNull()
    )
    none = F.lit("")
    opening = F.when(F.col("starts_inside"), F.lit(THINK_OPEN)).otherwise(none)
    whole = F.concat(F.coalesce(opening, none), F.coalesce("carry_in", none), "text")
    kept = F.left(whole, F.length(whole) - F.length(F.coalesce("carry_out", none)))
    return parts.join(_part_edges(parts), [*ANSWER, "part"], "left").select(
        *ANSWER, "part", tx.visible_text(kept).alias("text")
    )


def clean_turns(turns: DataFrame) -> DataFrame:
    """Whole-text turns with reasoning removed and characters repaired."""
    return turns.withColumn("text", tx.visible_text(F.col("text")))


def transcripts(turns: DataFrame, keys=("conv_id",), part_turns: int = PART_TURNS) -> DataFrame:
    """Messages in turn order, as rows (keys, part, messages array<struct<role, content>>).

    `turn` must be a small dense number for parts of even size; any ascending integer is right.
    """
    message = F.struct("turn", "role", F.col("text").alias("content"))
    messages = F.transform(
        F.sort_array(F.collect_list(message)),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
    )
    return (
        turns.withColumn("part", ordered.block_of("turn", part_turns))
        .groupBy(*keys, "part")
        .agg(messages.alias("messages"))
    )


def sessions(commands: DataFrame) -> DataFrame:
    """Messages with their session: the number of clear and quit commands before them.

    Blank input and commands are no messages. A quit ends the chat, so the next message opens
    a new session, as after a clear command.
    """
    word = strip_space(F.col("text"))
    slim = commands.withColumn("text", word).filter(F.col("text") != "")
    out = ordered.running(
        slim,
        ["user_id"],
        ["seq"],
        "block",
        sums={
            "session": F.col("text").isin(CLEAR_COMMAND, *QUIT_COMMANDS).cast("bigint"),
        },
    )
    return out.filter(~F.col("text").isin(CLEAR_COMMAND, *QUIT_COMMANDS)).select(
        "user_id", "session", "block", "seq", "text"
    )


def prompt_contexts(turns: DataFrame, keys=("conv_id",)) -> DataFrame:
    """What is sent with each turn: the session's messages up to it.

    The context of a turn is a prefix of its session, so it is given as a range: first turn,
    number of messages and characters. Writing the text out again for every turn would grow
    with the square of the session; `transcripts` holds the messages once.
    """
    out = ordered.running(
        turns,
        list(keys),
        ["turn"],
        "block",
        sums={"context_messages": F.lit(1), "context_chars": F.length("text").cast("bigint")},
        maxes={"_first": -F.col("turn")},
    )
    return out.select(
        *keys,
        "turn",
        "role",
        (-F.col("_first")).alias("context_first_turn"),
        "context_messages",
        "context_chars",
    )
