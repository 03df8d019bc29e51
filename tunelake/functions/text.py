"""Chat text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BPE_NEWLINE, BPE_SPACE, THINK_CLOSE, THINK_OPEN

REASONING_BLOCK = rf"(?s){THINK_OPEN}.*?(?:{THINK_CLOSE}|\z)"


def _tag_starts(tag):
    return [tag[:n] for n in range(len(tag) - 1, 0, -1)]


# a text end that could still grow into either tag, longest first
PARTIAL_TAG = "(" + "|".join(
    sorted(set(_tag_starts(THINK_OPEN) + _tag_starts(THINK_CLOSE)), key=len, reverse=True)
) + r")\z"


def strip_reasoning(text: Column) -> Column:
    """Drop reasoning blocks; an unclosed block runs to the end of the text."""
    return F.regexp_replace(text, REASONING_BLOCK, "")


def repair_bpe(text: Column) -> Column:
    """Replace byte-level tokenizer characters by the newline and space they stand for."""
    return F.translate(text, BPE_NEWLINE + BPE_SPACE, "\n ")


def visible_text(text: Column) -> Column:
    """What a reader sees: blocks go first, so repaired characters never form a tag."""
    return repair_bpe(strip_reasoning(text))


def partial_tag(text: Column) -> Column:
    """The end of the text that may be the start of a tag ('' when there is none)."""
    return F.regexp_extract(text, PARTIAL_TAG, 1)


def ends_in_reasoning(text: Column) -> Column:
    """True/False by the last whole tag in the text, NULL when it has none."""
    tags = F.regexp_extract_all(text, F.lit(f"({THINK_OPEN}|{THINK_CLOSE})"), 1)
    return F.try_element_at(tags, F.lit(-1)) == THINK_OPEN
