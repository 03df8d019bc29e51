"""Expressions over one training-log line."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind
from .constants import (
    CHECKPOINT_PATTERN,
    MARGIN_FLOOR,
    MARGIN_SHARE,
    METRIC_FIELDS,
    METRICS_PATTERN,
    TOTAL_STEPS_PATTERN,
)

NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf(inity)?)\s*$"
JSON_ONLY_WORD = r":\s*(null|true|false)\s*[,}]"
NOT_PLAIN = r"None|True|False|null|true|false|,\s*\}|:\s*[+(]|:\s*-?\.\d|\d\.\s*[,}eE]|\d_\d"
# number forms of a Python literal that JSON lacks: sign, underscores, a dot in front or at the end; and tuples
NUMBER_FORMS = [
    (r":\s*\+(?=[\d.])", ": "),
    (r"(?<=\d)_(?=\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?\s*[,}])", ""),
    (r"(?<=\d)_(?=\d[\d_]*\s*[,}])", ""),
    (r":\s*\.(?=\d)", ": 0."),
    (r":\s*-\.(?=\d)", ": -0."),
    (r"(:\s*-?\d+)\.(?=\s*[,}eE])", "$1.0"),
    (r":\s*\([^()'\"]*\)(?=\s*[,}])", ": null"),
]


def is_metrics(line: Column) -> Column:
    """The line reports a training loss (`eval_loss` and the like do not count)."""
    return F.coalesce(line.rlike(METRICS_PATTERN), F.lit(False))


def _as_json(group: Column) -> Column:
    """Rewrite a Python dict literal to JSON text; NULL when it is not one."""
    out = F.when(~group.rlike(JSON_ONLY_WORD), group)
    for word, value in (("None", "null"), ("True", "1"), ("False", "0")):
        out = F.regexp_replace(out, rf":\s*{word}(?=\s*[,}}])", f": {value}")
    for form, value in NUMBER_FORMS:
        out = F.regexp_replace(out, form, value)
    out = F.regexp_replace(out, r",\s*\}$", "}")
    return F.when(group.rlike(NOT_PLAIN), out).otherwise(group)


def _number(raw: Column) -> Column:
    """float() of a text; the pattern keeps out suffixes a SQL cast would accept."""
    return bind(raw, lambda r: F.when(r.rlike(NUMBER), F.trim(r).try_cast("double")))


def parse_metrics(line: Column) -> Column:
    """struct(loss, grad_norm, learning_rate, epoch) of the first dict in the line that parses."""
    options = {"allowNonNumericNumbers": "false"}
    groups = F.regexp_extract_all(line, F.lit(r"\{[^}]+\}"), 0)
    dicts = F.filter(
        F.transform(groups, lambda g: F.from_json(_as_json(g), "map<string,string>", options)),
        lambda d: d.isNotNull(),
    )
    values = F.transform(
        dicts,
        lambda d: F.struct(*[_number(F.try_element_at(d, F.lit(k))).alias(k) for k in METRIC_FIELDS]),
    )
    return F.when(is_metrics(line), F.get(values, F.lit(0)))


def total_steps(line: Column) -> Column:
    found = F.regexp_extract(line, TOTAL_STEPS_PATTERN, 1)
    return F.nullif(found, F.lit("")).try_cast("bigint")


def checkpoint_step(path: Column) -> Column:
    """Step number in the base name of a checkpoint path."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, CHECKPOINT_PATTERN, 1), F.lit("")).try_cast("bigint")


def within_target(loss: Column, target: Column) -> Column:
    """Loss at or below the target plus its margin; NULL and NaN are never within."""
    margin = F.greatest(F.lit(MARGIN_FLOOR), F.abs(target) * MARGIN_SHARE)
    return F.coalesce(loss <= target + margin, F.lit(False))
