"""Ignore rules as data: the lines of all ``.gitignore`` files are one table, and a path is decided by its ancestors' rules
in one join, where the last rule that matches wins. What lies below an ignored folder is ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = ".gitignore"
#: Of the folder a file lies in, relative to which patterns count; ``pattern`` matches whole relative paths.
RULES = "folder string, line int, pattern string, negated boolean, only_folders boolean"


def rule(line: str) -> tuple[str, bool, bool] | None:
    """Pattern, whether it takes back, and whether it is for folders only; null for blank lines and comments."""
    body = line.rstrip("\r\n")
    while body.endswith(" ") and not body.endswith("\\ "):
        body = body[:-1]
    if not body or body.startswith("#"):
        return None
    negated, body = body.startswith("!"), body.removeprefix("!")
    only_folders, body = body.endswith("/"), body.rstrip("/")
    if not body:
        return None
    anchored, body = "/" in body, body.removeprefix("/")
    return ("" if anchored else "(?:.*/)?") + _translated(body), negated, only_folders


def _translated(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i:] == "**" and i and glob[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] in "!^"))) > 0:
            inner = glob[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "(?!/)[" + "".join("\\" + x if x in "[]&\\" else x for x in inner) + "]", end + 1
        else:
            i += c == "\\" and i + 1 < len(glob)
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() and glob[i].isascii() else glob[i]), i + 1
    return out


def rules_of(folder: str, text: str) -> list[tuple[str, int, str, bool, bool]]:
    return [(folder, k, *found) for k, line in enumerate(text.split("\n")) if (found := rule(line))]


def _folders(path: str) -> str:
    """SQL for the folders above a path, from the top, whose name is empty."""
    return f"transform(sequence(0, size(split({path}, '/')) - 1), k -> array_join(slice(split({path}, '/'), 1, k), '/'))"


def decided(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """``entries(path, is_dir, ...)`` with ``ignored``, by rules for the path itself; folders above it are not looked at."""
    keys = entries.select("path", "is_dir").distinct()
    above = keys.withColumn("folder", F.explode(F.expr(_folders("path")))).join(rules, "folder")
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    hit = above.withColumn("rel", below).filter((F.col("is_dir") | ~F.col("only_folders")) & F.expr("rel rlike concat('(?s)^(?:', pattern, ')$')"))
    last = hit.groupBy("path", "is_dir").agg(F.max_by(~F.col("negated"), F.struct(F.length("folder"), "line")).alias("ignored"))
    return entries.join(last, ["path", "is_dir"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files(path, ...)`` of which neither the path nor a folder above it is ignored; ``.git`` always is."""
    parts = files.select("path").distinct().withColumn("prefix", F.explode(F.expr("transform(sequence(1, size(split(path, '/'))), k -> array_join(slice(split(path, '/'), 1, k), '/'))")))
    entries = parts.select(F.col("prefix").alias("path"), (F.col("prefix") != F.col("path")).alias("is_dir")).distinct()
    bad = decided(entries, rules).filter(F.col("ignored") | (F.substring_index("path", "/", -1) == ".git")).select(F.col("path").alias("prefix"), "is_dir")
    gone = parts.withColumn("is_dir", F.col("prefix") != F.col("path")).join(bad, ["prefix", "is_dir"], "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")
