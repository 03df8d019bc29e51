"""Dataset format detection on raw JSON records (no schema inference).

A key that is present with a null value counts as present, so every test looks at the keys
of the raw record text, never at inferred columns.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind
from .constants import FROM_TAGS, READINESS_BANDS, ROLE_TAGS, TAG_FIELDS

STRICT = {"allowSingleQuotes": "false"}


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def strip_space(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def single_object(text: Column) -> Column:
    """The text if it is exactly one JSON object, else NULL.

    Wrapping in an array makes the parser reject trailing text, which it otherwise ignores.
    """
    items = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    return F.when((F.size(items) == 1) & text.rlike(r"^\s*\{"), text)


def array_items(text: Column) -> Column:
    """Raw text of each element if the document is exactly one JSON array, else NULL."""
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<array<string>>", STRICT)
    only = lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0)))
    return F.when(text.rlike(r"^\s*\["), bind(wrapped, only))


def _in(keys: Column, *names: str) -> Column:
    test = F.array_contains(keys, names[0])
    for name in names[1:]:
        test = test & F.array_contains(keys, name)
    return F.coalesce(test, F.lit(False))


def key_of(keys: Column) -> Column:
    return F.when(_in(keys, "messages"), F.lit("messages")).when(
        _in(keys, "conversations"), F.lit("conversations")
    )


def shape_of(keys: Column) -> Column:
    """What the record is: one of the five known shapes, or NULL."""
    return (
        F.when(_in(keys, "instruction", "output"), F.lit("instruction"))
        .when(key_of(keys).isNotNull(), F.lit("chat"))
        .when(_in(keys, "prompt", "completion"), F.lit("completion"))
        .when(_in(keys, "text"), F.lit("text"))
    )


def _format_of(shape: Column) -> Column:
    return F.when(shape == "chat", F.lit("sharegpt")).when(shape.isNotNull(), F.lit("alpaca"))


def record_shape(record: Column) -> Column:
    return bind(F.json_object_keys(record), shape_of)


def record_format(record: Column) -> Column:
    """`alpaca`, `sharegpt` or NULL, from the keys of one record."""
    return _format_of(record_shape(record))


def _chat_key(keys: Column) -> Column:
    return F.when(~_in(keys, "instruction", "output"), key_of(keys))


def message_column(record: Column) -> Column:
    """Name of the field that holds the messages of a chat record: `messages` wins."""
    return bind(F.json_object_keys(record), _chat_key)


def _style_of(messages: Column) -> Column:
    """`role` or `from` by the keys of the first message, if that is an object."""
    first = F.when(messages.rlike(r"^\s*\[\s*\{"), F.get_json_object(messages, "$[0]"))
    return bind(
        F.json_object_keys(first),
        lambda keys: F.when(_in(keys, "role"), F.lit("role")).when(_in(keys, "from"), F.lit("from")),
    )


def message_text(record: Column, key: Column) -> Column:
    """Raw JSON text of the messages field."""
    return F.when(key == "messages", F.get_json_object(record, "$.messages")).when(
        key == "conversations", F.get_json_object(record, "$.conversations")
    )


def tag_style(record: Column) -> Column:
    """`role` or `from`, decided by the first message; NULL when it tells nothing."""
    return bind(message_text(record, message_column(record)), _style_of)


def classification(record: Column) -> Column:
    """struct(format, message_key, tag_style) of one record, its keys read once."""

    def describe(keys):
        key = _chat_key(keys)
        return F.struct(
            _format_of(shape_of(keys)).alias("format"),
            key.alias("message_key"),
            bind(message_text(record, key), _style_of).alias("tag_style"),
        )

    return bind(F.json_object_keys(record), describe)


def tag_map(style: Column) -> Column:
    """The five tags of a style, as a map (NULL style gives NULL)."""
    literal = lambda tags: F.create_map(
        *[F.lit(x) for field in TAG_FIELDS for x in (field, tags[field])]
    )
    return F.when(style == "role", literal(ROLE_TAGS)).when(style == "from", literal(FROM_TAGS))


def columns_map(key: Column) -> Column:
    return F.when(key.isNotNull(), F.create_map(F.lit("messages"), key))


def readiness(n: Column) -> Column:
    """Readiness band of a dataset by its number of examples."""
    (floor, band), *rest = READINESS_BANDS
    expr = F.when(n >= floor, F.lit(band))
    for floor, band in rest:
        expr = expr.when(n >= floor, F.lit(band))
    return expr
