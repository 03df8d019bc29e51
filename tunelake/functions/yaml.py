"""Flat YAML documents (`key: value` lines) as column expressions.

The lines of a document are folded into entries by an aggregate whose state is the open entry:
its key, the text so far, and what it is in the middle of. Values may be plain, in single or
double quotes, or blocks; they may run over several lines and be followed by comments. Nested
mappings and lists give an entry without a value.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

# fixed values: the words for null, and the escapes of double-quoted scalars
NULL_WORDS = ["null", "Null", "NULL", "~", ""]
ESCAPES = {
    "0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b",
    "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029",
}

DOUBLE = r'(?s)^"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
SINGLE = r"(?s)^'([^']*+(?:''[^']*+)*+)'(?!')"
AFTER = r"[ \t]*(?:$|[ \t]#.*$)"
KEYS = [r'^"([^"\\]*+(?:\\.[^"\\]*+)*+)"[ \t]*:(?:[ \t](.*))?$', r"^'([^']*+(?:''[^']*+)*+)'[ \t]*:(?:[ \t](.*))?$",
        r"^([^\s#'\"\-\[\]{},&*!|>%@`?:](?:[^#:]|:(?=\S)|(?<=\S)#)*?|-[^\s:#]+)[ \t]*:(?:[ \t](.*))?$"]
COMMENT = r"(?:^|[ \t])#"
NESTED = r"^[ \t]+(?:-(?:[ \t]|$)|[^\s'\"#][^:#]*:(?:[ \t]|$))"
WORD = r"^[A-Za-z0-9_]"
BLOCK = r"^[|>][-+0-9]*[ \t]*(?:#.*)?$"

STATE = "struct<done: array<struct<key: string, raw: string>>, key: string, raw: string, mode: string, bad: boolean>"


def _key(line: Column) -> Column:
    """struct(key, rest) of a line that begins an entry, else NULL."""
    double, single, plain = KEYS
    found = lambda pattern, use: F.struct(
        use(F.regexp_extract(line, pattern, 1)).alias("key"), F.ltrim(F.regexp_extract(line, pattern, 2)).alias("rest")
    )
    # most lines begin with a word, which needs no look for quotes
    return F.when(line.rlike(WORD), F.when(line.rlike(plain), found(plain, lambda k: k))).otherwise(
        F.when(line.rlike(double), found(double, _unescaped))
        .when(line.rlike(single), found(single, lambda k: F.replace(k, F.lit("''"), F.lit("'"))))
        .when(line.rlike(plain), found(plain, lambda k: k))
    )


def _mode(raw: Column) -> Column:
    """What a value that begins like this is in the middle of."""
    quoted = lambda mark, whole: F.when(raw.rlike(whole), "done").otherwise(mark)
    return (
        F.when(raw.startswith('"'), quoted('"', DOUBLE))
        .when(raw.startswith("'"), quoted("'", SINGLE))
        .when((raw.startswith("|") | raw.startswith(">")) & raw.rlike(BLOCK), "block")
        .when(raw.startswith("#"), "plain")
        .when(raw.contains("#") & raw.rlike(COMMENT), "done")
        .otherwise("plain")
    )


def _content(raw: Column) -> Column:
    """A value's text so far, empty while there is nothing but a comment."""
    return F.when(raw.startswith("#"), F.lit("")).otherwise(F.trim(raw))


def _closed(s: Column) -> Column:
    """The entries with the open one, if there is one."""
    entry = F.struct(s["key"].alias("key"), s["raw"].alias("raw"))
    return F.when(s["key"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(entry)))


def _step(s: Column, line: Column) -> Column:
    same = {"done": s["done"], "key": s["key"], "raw": s["raw"], "mode": s["mode"], "bad": s["bad"]}

    def state(**new):
        values = same | new
        # of the state's types already: a cast would copy all entries at every line
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])

    longer = F.concat(s["raw"], F.lit("\n"), line)
    closed = _closed(s)
    empty = (s["mode"] == "plain") & (_content(s["raw"]) == "")
    begun = F.ltrim(line, F.lit(" \t"))
    opened = bind(_key(line), lambda k: F.when(k.isNull(), state(bad=s["bad"] | s["key"].isNotNull())).otherwise(
        state(done=closed, key=k["key"], raw=k["rest"], mode=_mode(k["rest"]), bad=s["bad"] | ((s["mode"] == "scalar")))
    ))
    return (
        F.when(s["mode"] == '"', state(raw=longer, mode=F.when(longer.rlike(DOUBLE), "done").otherwise('"')))
        .when(s["mode"] == "'", state(raw=longer, mode=F.when(longer.rlike(SINGLE), "done").otherwise("'")))
        .when(line.rlike(WORD), opened)
        .when((s["mode"] == "block") & line.rlike(r"^(?:[ \t].*|)$"), state(raw=longer))
        .when(line.rlike(r"^\s*$"), F.when((s["mode"] == "plain") & ~empty, state(raw=longer)).otherwise(state()))
        .when(line.rlike(r"^\s*#"), F.when((s["mode"] == "plain") & ~empty, state(mode="done")).otherwise(state()))
        .when(
            line.rlike(r"^[ \t]"),
            F.when(s["mode"] == "nested", state())
            .when(empty & line.rlike(NESTED), state(mode="nested"))
            .when(empty, state(raw=begun, mode=_mode(begun)))
            .when((s["mode"] == "plain") & s["key"].isNotNull(), state(
                raw=longer, mode=F.when(line.rlike(COMMENT), "done").otherwise("plain"), bad=s["bad"] | line.rlike(r":(?:[ \t]|$)")
            ))
            .otherwise(state(bad=s["bad"] | s["key"].isNotNull())),
        )
        .when(line.rlike(r"^(?:---|\.\.\.)(?:\s|$)|^%"), state(done=closed, key=F.lit(None).cast("string"), raw="", mode="none"))
        .when(line.rlike(r"^-(?:[ \t]|$)"), F.when(empty | (s["mode"] == "nested"), state(mode="nested")).otherwise(state(bad=s["bad"] | s["key"].isNotNull())))
        .otherwise(opened)
    )


def _folded(content: Column) -> Column:
    """The state after all lines; the last entry is among `done`."""
    start = F.struct(
        F.array().alias("done"), F.lit(None).alias("key"), F.lit("").alias("raw"), F.lit("none").alias("mode"), F.lit(False).alias("bad")
    ).cast(STATE)
    last = lambda s: F.struct(
        _closed(s).alias("done"),
        (s["bad"] | s["mode"].isin('"', "'")).alias("bad"),
    )
    lines = F.split(F.regexp_replace(F.coalesce(content, F.lit("")), r"^\x{FEFF}", ""), r"\r\n|\r|\n")
    return F.aggregate(lines, start, _step, last)


def _flow(text: Column) -> Column:
    """Line breaks of a flow scalar: one is a blank, n are n - 1 breaks."""
    trimmed = F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(trimmed, r"(?<!\n)\n(?!\n)", " "), r"\n(\n+)", "$1")


def _unescaped(text: Column) -> Column:
    """Double-quoted text with its escapes resolved."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[^\\]+"), 0)
    names = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def one(t):
        sign = F.substr(t, F.lit(2), F.lit(1))
        code = F.decode(F.unhex(F.lpad(F.substr(t, F.lit(3)), 8, "0")), "UTF-32")
        return (
            F.when(~t.startswith("\\"), t)
            .when(sign.isin("x", "u", "U") & (F.length(t) > 2), code)
            .otherwise(F.coalesce(F.try_element_at(names, sign), sign))
        )

    return F.when(text.contains("\\"), F.array_join(F.transform(tokens, one), "")).otherwise(text)


def _block(raw: Column) -> Column:
    """Text of a block scalar: its header line, then its lines."""
    header = F.substring_index(raw, "\n", 1)
    lines = F.split(F.substr(raw, F.length(header) + 2), "\n")
    first = F.get(F.filter(lines, lambda x: x.rlike(r"\S")), F.lit(0))
    indent = F.length(first) - F.length(F.ltrim(first))
    text = F.array_join(F.transform(lines, lambda x: F.substr(x, indent + 1)), "\n")
    kept = F.regexp_replace(text, r"\n+$", "")
    # lines that are indented further keep their breaks
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?<=[^\n])(?<!\n[ \t][^\n]{0,999})\n(?![\n \t])", " "), r"(?<=[^\n ])\n(\n+)(?![ \t])", "$1")
    body = F.when(header.startswith(">"), joined).otherwise(kept)
    end = F.when(header.contains("-"), F.lit("")).when(header.contains("+"), F.concat(F.regexp_extract(text, r"(\n*)$", 1), F.lit("\n"))).otherwise(F.lit("\n"))
    return F.when(first.isNull(), F.lit("")).otherwise(F.concat(body, end))


def scalar(raw: Column) -> Column:
    """Value of an entry's raw text; NULL for a null word or nothing."""
    inner = lambda pattern: F.regexp_extract(raw, pattern, 1)
    escaped_break = r"(?<!\\)((?:\\\\)*)\\\n[ \t]*"
    uncommented = F.when(raw.contains("#"), F.regexp_replace(raw, r"(?m)(?:^|[ \t]+)#.*$", "")).otherwise(raw)
    plain = F.trim(F.when(raw.contains("\n"), _flow(uncommented)).otherwise(uncommented), F.lit(" \t\n"))
    return (
        F.when(raw.startswith('"'), _unescaped(_flow(F.regexp_replace(inner(DOUBLE), escaped_break, "$1"))))
        .when(raw.startswith("'"), F.replace(_flow(inner(SINGLE)), F.lit("''"), F.lit("'")))
        .when((raw.startswith("|") | raw.startswith(">")) & raw.rlike(r"^[|>][-+0-9]*[ \t]*(?:#.*)?(?:\n|$)"), _block(raw))
        .otherwise(bind(plain, lambda p: F.when(~p.isin(NULL_WORDS), p)))
    )


def flat_entries(content: Column) -> Column:
    """array<struct<key, value>> of the entries of a document, in order."""
    return F.transform(
        _folded(content)["done"], lambda e: F.struct(e["key"].alias("key"), bind(e["raw"], scalar).alias("value"))
    )


def flat_valid(content: Column) -> Column:
    """The text reads as a flat document: quotes close, nothing follows them, lines are entries."""

    def sound(state):
        tail = lambda pattern: F.regexp_replace(F.regexp_replace(pattern[0], pattern[1], ""), r"(?m)[ \t]+#.*$", "")
        clean = lambda e: (
            F.when(e["raw"].startswith('"'), F.trim(tail((e["raw"], DOUBLE)), F.lit(" \t\n")) == "")
            .when(e["raw"].startswith("'"), F.trim(tail((e["raw"], SINGLE)), F.lit(" \t\n")) == "")
            .otherwise(~e["raw"].rlike(r"^[@`%]") & ~e["raw"].rlike(r"^[^'\"\[{|>#\n]*[^\s:#]:(?:[ \t]|$)"))
        )
        return ~state["bad"] & F.forall(state["done"], clean)

    return F.coalesce(bind(_folded(content), sound), F.lit(False))
