"""Text transforms of prompts, replies, documents and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "`" * 3
SPACE = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, SPACE, "")


def code_block(text: Column, lang: str = "julia") -> Column:
    """The first fenced block with this language tag or none; without one, the whole text. Stripped.

    Where only another language's block stands, its closing fence opens the match: what follows it counts."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){FENCE}(?:{lang})?\\s*\\n(.*?){FENCE}"), F.lit(1))
    return strip(F.coalesce(F.get(found, F.lit(0)), text))


def module_name(code: Column) -> Column:
    """The name that the first line starts a module with; NULL without one."""
    name = F.regexp_extract(code, r"^module\s+(\w+)", 1)
    return F.when(name != "", name)


def last_line(text: Column) -> Column:
    """The last line that is not blank, stripped; else empty."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def pass_fail(stdout: Column, exit_ok: Column) -> Column:
    return exit_ok & (last_line(stdout) == "PASS")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Each ``{{KEY}}`` replaced by its value."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def render_docs(snippets: Column) -> Column:
    """Numbered blocks of array<struct<title, source_url, excerpt>>; those without excerpt are left out but counted."""
    block = lambda s, i: F.when(F.coalesce(strip(s["excerpt"]), F.lit("")) != "", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["title"], F.lit("\nSource: "), s["source_url"], F.lit("\n"), s["excerpt"]))
    return F.array_join(F.filter(F.transform(snippets, block), lambda x: x.isNotNull()), "\n")


def strip_html(html: Column) -> Column:
    """Without scripts, styles and tags; white space collapsed."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    return strip(F.regexp_replace(html, r"\s+", " "))


def excerpt(text: Column, most: int = 1200, fallback: str = "No documentation excerpt available.") -> Column:
    return F.when(text == "", fallback).otherwise(F.substring(text, 1, most))


def prompt(task: Column, docs: Column, suffix: Column) -> Column:
    """Task, documentation and suffix, parted by blank lines; empty parts are left out."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(x, F.lit("")) != "", x) for x in (task, docs, suffix)])


def int_list(text: Column) -> Column:
    """Positive integers parted by commas or white space; anything else is an error."""
    parts = F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")
    number = lambda x: F.when(x.cast("int") > 0, x.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a positive integer: "), x)).cast("int"))
    return F.transform(parts, number)


def markdown_cell(x: Column) -> Column:
    """Two decimals; ``---`` for what is not finite, nothing for NULL."""
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull(), "").when(odd, "---").otherwise(F.format_string("%.2f", x))


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def sorted_json(pairs: dict[str, Column]) -> Column:
    """A JSON object with its keys in order."""
    return F.to_json(F.struct(*[pairs[k].alias(k) for k in sorted(pairs)]), {"ignoreNullFields": "false"})
