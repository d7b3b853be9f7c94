"""Options of runs as a table: a fold over each row's arguments, with types, defaults and precedence.

An argument is ``--name=value``, ``--name value``, or ``--name`` alone for a flag; of several with one name the last counts. An
option comes from the arguments, else from the row's environment, else it has its default. Names may be written with
``-`` or ``_``. What is no option is skipped or refused. Everything is Spark SQL expressions, so a table of millions of runs is
read like one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"int": "int", "long": "bigint", "double": "double", "text": "string", "flag": "boolean", "ints": "array<int>", "texts": "array<string>"}
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


@dataclass(frozen=True)
class Option:
    """``env`` names the variable that stands in for the argument; ``choices`` are the only values (or parts of a list)."""

    name: str
    kind: str
    default: object = None
    env: str | None = None
    choices: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"the kind of {self.name} is one of {', '.join(KINDS)}")


def parsed(args: Column, options: list[Option], unknown: str = "skip") -> Column:
    """array<struct<name, value>> of ``args`` (array of text), in their order. ``unknown`` is ``skip`` or ``refuse``."""
    if unknown not in ("skip", "refuse"):
        raise ValueError("unknown arguments are skipped or refused")
    flags, names = [o.name for o in options if o.kind == "flag"], [o.name for o in options]
    kind = "struct<open: string, found: array<struct<name: string, value: string>>>"
    refuse = lambda x: F.raise_error(F.concat(F.lit("unknown argument "), x)).cast("string")

    def step(acc: Column, arg: Column) -> Column:
        name = F.replace(F.regexp_extract(arg, r"^--([^=]+)", 1), F.lit("-"), F.lit("_"))
        put = lambda n, v: F.concat(acc["found"], F.array(F.struct(n.alias("name"), v.alias("value"))))
        state = lambda o, found: F.struct(o.cast("string").alias("open"), found.alias("found"))
        known, none = name.isin(names), F.lit(None).cast("string")
        checked = name if unknown == "skip" else F.when(known, name).otherwise(refuse(arg))
        stray = state(none if unknown == "skip" else refuse(arg), acc["found"])
        return (
            F.when(acc["open"].isNotNull(), state(none, F.when(acc["open"].isin(names), put(acc["open"], arg)).otherwise(acc["found"])))
            .when(arg.rlike(r"^--[^=]+="), state(none, F.when(checked.isin(names), put(name, F.regexp_replace(arg, r"(?s)^--[^=]+=", ""))).otherwise(acc["found"])))
            .when(name.isin(flags), state(none, put(name, F.lit("true"))))
            .when(name != "", state(checked, acc["found"]))
            .otherwise(stray)
        )

    first = F.from_json(F.lit('{"open": null, "found": []}'), kind)

    def last(acc: Column) -> Column:
        dangling = F.raise_error(F.concat(F.lit("no value for --"), acc["open"])).cast("array<struct<name: string, value: string>>")
        return F.when(acc["open"].isNull() | ~acc["open"].isin(names), acc["found"]).otherwise(dangling)

    return F.aggregate(args, first, step, last)


def _typed(o: Option, text: Column) -> Column:
    """``text`` as a value of the option; an error where it is none."""
    wrong = F.raise_error(F.concat(F.lit(f"{o.name}: not a value of type {o.kind}: "), text))
    trimmed = F.trim(text)
    allowed = lambda x: x if not o.choices else F.when(x.isin(*o.choices), x).otherwise(F.raise_error(F.concat(F.lit(f"{o.name}: "), x, F.lit(f" is not one of {', '.join(o.choices)}"))).cast("string"))
    one = lambda x, sql: F.coalesce(x.try_cast(sql), wrong.cast(sql))
    if o.kind in ("int", "long", "double"):
        return F.when(text.isNotNull(), one(allowed(trimmed), KINDS[o.kind]))
    if o.kind == "flag":
        low = F.lower(trimmed)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(text.isNotNull(), wrong.cast("boolean"))
    if o.kind == "text":
        return F.when(text.isNotNull(), allowed(text))
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.isNotNull(), F.transform(parts, lambda x: one(allowed(x), "int") if o.kind == "ints" else allowed(x)))


def _named(name: str) -> Callable[[Column], Column]:
    return lambda x: x["name"] == name


def resolved(rows: DataFrame, options: list[Option], args: str = "args", env: str | None = None, unknown: str = "skip") -> DataFrame:
    """``rows`` with a column for each option in place of ``args`` (array of text) and ``env`` (map of text to text); null
    arguments are none."""
    found = F.coalesce(parsed(F.coalesce(args, F.array().cast("array<string>")), options, unknown), F.array().cast("array<struct<name: string, value: string>>"))
    work = rows.withColumn("_found", found)
    columns = []
    for o in options:
        given = F.try_element_at(F.filter("_found", _named(o.name)), F.lit(-1))["value"]
        text = F.coalesce(given, F.col(env)[o.env]) if env and o.env else given
        kind = KINDS[o.kind]
        default = F.array(*[F.lit(x) for x in o.default]) if isinstance(o.default, (list, tuple)) else F.lit(o.default)
        columns.append(F.coalesce(_typed(o, text), default.cast(kind)).alias(o.name))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (args, env)]
    return work.select(*kept, *columns)
