"""Column functions on text: segments, budgets, breadcrumbs and ids."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
TOKEN_BUDGET = 1900


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def comma_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def _not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda x: F.regexp_replace(x, r"(?U)\s", "") != "")


def paragraphs(text: Column) -> Column:
    return _not_blank(F.split(text, r"\n\n+"))


def sentences(text: Column) -> Column:
    return _not_blank(F.split(text, r"(?U)(?<=[.!?])\s+"))


def hard_split(text: Column, budget: int = TOKEN_BUDGET) -> Column:
    """Pieces of as many characters as the budget stands for; an empty text has none."""
    width = budget * CHARS_PER_TOKEN
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(width)))


def greedy_merge(parts: Column, separator: str, budget: int = TOKEN_BUDGET) -> Column:
    """Join neighbours while their estimates, with the separator's, stay in the budget. The running
    sum starts anew with each piece, so this is a fold over the array."""
    cost = len(separator) // CHARS_PER_TOKEN
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).cast("bigint").alias("used"))

    def step(state: Column, part: Column) -> Column:
        used = token_estimate(part)
        fits = state["used"] + used + cost <= budget
        return (
            F.when(state["open"].isNull(), F.struct(state["done"].alias("done"), part.alias("open"), used.alias("used")))
            .when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit(separator), part).alias("open"), (state["used"] + used + cost).alias("used")))
            .otherwise(F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), part.alias("open"), used.alias("used")))
        )

    return F.aggregate(parts, empty, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def resplit(text: Column, budget: int = TOKEN_BUDGET) -> Column:
    """Texts over the budget as merged paragraphs, those over it as merged sentences, and what is
    over it still by length."""

    def finer(pieces: Column, cut) -> Column:  # noqa: ANN001
        return F.flatten(F.transform(pieces, lambda p: F.when(token_estimate(p) <= budget, F.array(p)).otherwise(cut(p))))

    by_paragraph = greedy_merge(paragraphs(text), "\n\n", budget)
    by_sentence = finer(by_paragraph, lambda p: greedy_merge(sentences(p), " ", budget))
    return F.when(token_estimate(text) <= budget, F.array(text)).otherwise(finer(by_sentence, lambda p: hard_split(p, budget)))


def content_type(text: Column) -> Column:
    code, grid = text.contains("```"), text.rlike(r"(?md)^\|[^\n]+\|")
    return F.when(code & grid, "mixed").when(code, "code").when(grid, "table").otherwise("text")


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def first_heading(text: Column) -> Column:
    """The text after the first line's number signs; blanks before it may be line ends."""
    return F.nullif(F.regexp_extract(text, r"(?mdU)^#+\s+([^\n]+)", 1), F.lit(""))


def breadcrumb(parents: Column, heading: Column) -> Column:
    """Parents and the heading, unless it repeats the last one; ``Document`` if there is neither."""
    own = F.when(heading.isNull() | (F.coalesce(F.try_element_at(parents, F.lit(-1)), F.lit("")) == heading), F.array().cast("array<string>")).otherwise(F.array(heading))
    joined = F.array_join(F.concat(parents, own), " > ")
    return F.when(joined == "", "Document").otherwise(joined)


def level(crumb: Column) -> Column:
    return F.when(crumb == "Document", 1).otherwise(F.least(F.size(F.split(crumb, " > ")), F.lit(3)))


def last_component(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def module_name(path: Column) -> Column:
    """``a/b/__init__.py`` and ``a/b.py`` are both ``a.b``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def duration_ms(value: Column) -> Column:
    """``3d``, ``2w``, ``5h`` or ``10m``; an error for anything else."""
    unit = F.regexp_extract(value, r"^(\d+)([dwhm])$", 2)
    factor = F.when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000).when(unit == "w", 604_800_000)
    number = F.regexp_extract(value, r"^(\d+)([dwhm])$", 1).try_cast("bigint")
    return F.when(factor.isNotNull(), number * factor).otherwise(F.raise_error(F.concat(F.lit("not a duration: "), value)))


def ellipsis(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def glob_pattern(glob: str, watcher: bool = False) -> str:
    """A full-match pattern for a glob: ``**/`` is any folders, ``*`` stays inside one name. When a folder is scanned, any
    other ``**`` is everything below and ``?`` one character; to a ``watcher`` a ``**`` is two stars and ``?`` itself."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("**", i) and not watcher:
            out, i = out + ".*", i + 2
        elif glob[i] == "?" and not watcher:
            out, i = out + "[^/]", i + 1
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r"\.[]{}()+-^$|?" else glob[i]), i + 1
    return f"^{out}$"


def json_list(text: Column) -> Column:
    """A JSON list of texts; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    """A JSON object as a map of texts; anything else is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))


def title(frontmatter: Column, path: Column) -> Column:
    """The header's title, else the last part of the path, else the path."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(F.get_json_object(frontmatter, "$.title"), F.lit("")), F.nullif(name, F.lit("")), path)


def tags(frontmatter: Column, labels: Column) -> Column:
    """The header's tags, a list or a text with commas, else the labels."""
    said = F.get_json_object(frontmatter, "$.tags")
    return F.coalesce(F.when(said.startswith("["), json_list(said)).when(said.isNotNull(), comma_list(said)), labels)


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def utc(milliseconds: Column) -> Column:
    return F.timestamp_millis(milliseconds)


def version(text: Column) -> Column:
    """``major.minor.patch`` as a struct of numbers; null if the text is no such version."""
    part = lambda k: F.regexp_extract(text, r"^(\d+)\.(\d+)\.(\d+)", k).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def compatible(mine: Column, theirs: Column) -> Column:
    """Whether two versions have the same major number; what is no version is not compatible."""
    return F.coalesce(version(mine)["major"] == version(theirs)["major"], F.lit(False))


def resplit_parts(text: Column, crumb: Column, budget: int = TOKEN_BUDGET) -> Column:
    """The parts of a text over the budget, numbered in their breadcrumbs and each with its own type."""
    pieces = resplit(text, budget)
    one = F.size(pieces) <= 1
    named = lambda i: F.when(one, crumb).otherwise(F.concat(crumb, F.lit("#part-"), (i + 1).cast("string")))
    return F.transform(pieces, lambda p, i: F.struct(i.alias("part"), named(i).alias("header_breadcrumb"), p.alias("content"), content_type(p).alias("content_type")))
