"""Names, paths and templates."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    DEFAULT_TEMPLATE,
    REASONING_MARKS,
    REASONING_TEMPLATE,
    TEMPLATE_BY_NAME,
    TEMPLATE_BY_TYPE,
)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*pairs.items())])


def repo_id(entry: Column) -> Column:
    """`models--org--name` to `org/name`; NULL for other cache folders."""
    parts = F.split(entry, "--")
    joined = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return F.when(entry.startswith("models--"), joined)


def safe_name(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("_"))


def _contains_any(text: Column, marks) -> Column:
    found = text.contains(marks[0])
    for mark in marks[1:]:
        found = found | text.contains(mark)
    return found


def reasoning_template(repo: Column) -> Column:
    return F.when(_contains_any(F.lower(repo), REASONING_MARKS), F.lit(REASONING_TEMPLATE))


def type_template(model_type: Column) -> Column:
    return F.try_element_at(literal_map(TEMPLATE_BY_TYPE), model_type)


def name_template(repo: Column) -> Column:
    lower = F.lower(repo)
    expr = None
    for marks, template in TEMPLATE_BY_NAME:
        test = _contains_any(lower, marks)
        expr = F.when(test, template) if expr is None else expr.when(test, template)
    return expr.otherwise(DEFAULT_TEMPLATE)


def template(repo: Column, model_type: Column) -> Column:
    """Reasoning override, then model type, then the name cascade."""
    return F.coalesce(reasoning_template(repo), type_template(model_type), name_template(repo))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=[^.])(\.[^.]*)$", 1)


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def export_name(adapter: Column) -> Column:
    """Default export folder of an adapter path."""
    bare = F.regexp_replace(adapter, r"[/\\]+$", "")
    bare = F.replace(F.replace(bare, F.lit("/lora"), F.lit("")), F.lit("\\lora"), F.lit(""))
    return F.concat(F.lit("models/"), base_name(bare))


def run_name(ts: Column) -> Column:
    return F.date_format(ts, "'run_'yyyyMMdd_HHmmss")


def adapter_dir(run: Column) -> Column:
    """Where a run writes its adapter, whatever its config says."""
    return F.concat(F.lit("saves/"), run, F.lit("/lora"))


def config_path(run: Column) -> Column:
    return F.concat(F.lit("configs/"), run, F.lit(".yaml"))
