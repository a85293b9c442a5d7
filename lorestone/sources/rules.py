"""Rules for paths as one trie over path components.

A folder's state is the set of the trie's nodes that its path leads to: what rules may still match below it. So a listing
stops at folders where no rule is alive, or where an exclude rule takes everything, and thousands of rules cost a file no more
than the few that are alive in its folder."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestone.functions.text import glob_pattern
from lorestone.operators.incremental import Rule

#: Components that a state's number can tell apart: where a pattern begins that goes over several of them.
DEEPEST = 1024


@dataclass
class _Node:
    names: dict[str, int] = field(default_factory=dict)
    globs: dict[str, tuple[re.Pattern, int]] = field(default_factory=dict)
    deep: int = -1  # the node that stays where it is in any folder
    stays: bool = False
    tail: int = -1  # the node that holds patterns for all of the path that is left, and stays with the place where they begin
    ends: list[int] = field(default_factory=list)
    rest: list[tuple[re.Pattern, int]] = field(default_factory=list)


class Trie:
    """The rules of a list, told apart by their places in it; picklable, and as large as the rules' text."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules, self.nodes = list(rules), [_Node()]
        for k, r in enumerate(self.rules):
            self._add(r.glob.split("/"), k)

    def _new(self, **of: bool) -> int:
        self.nodes.append(_Node(**of))
        return len(self.nodes) - 1

    def _add(self, parts: list[str], rule: int) -> None:
        at = 0
        for i, part in enumerate(parts):
            node = self.nodes[at]
            if part == "**" and i + 1 < len(parts):
                if node.deep < 0:
                    node.deep = self._new(stays=True)
                at = node.deep
            elif "**" in part:
                if node.tail < 0:
                    node.tail = self._new()
                self.nodes[node.tail].rest.append((re.compile(glob_pattern("/".join(parts[i:])), re.DOTALL), rule))
                return
            elif "*" in part or "?" in part:
                if part not in node.globs:
                    node.globs[part] = re.compile(glob_pattern(part), re.DOTALL), self._new()
                at = node.globs[part][1]
            else:
                if part not in node.names:
                    node.names[part] = self._new()
                at = self.nodes[at].names[part]
        self.nodes[at].ends.append(rule)

    def _closed(self, nodes: Iterable[int], depth: int) -> list[int]:
        """States of the nodes, and of those that any number of folders, none among them, leads to."""
        out: set[int] = set()
        todo = list(nodes)
        while todo:
            n = todo.pop()
            if n not in out:
                out.add(n)
                todo.extend(m for m in (self.nodes[n].deep, self.nodes[n].tail) if m >= 0)
        return [n * DEEPEST + min(depth, DEEPEST - 1) for n in sorted(out)]

    def root(self) -> list[int]:
        return self._closed([0], 0)

    def _next(self, states: Sequence[int], name: str) -> Iterator[int]:
        for s in states:
            node = self.nodes[s // DEEPEST]
            if name in node.names:
                yield node.names[name]
            yield from (n for pattern, n in node.globs.values() if pattern.search(name))

    def enter(self, states: Sequence[int], path: str) -> list[int]:
        """The states of a folder in one with ``states``; none if nothing below it can match, or all is excluded."""
        depth, name = path.count("/") + 1, path.rpartition("/")[2]
        stay = [s for s in states if self.nodes[s // DEEPEST].rest]
        stays = [s // DEEPEST for s in states if self.nodes[s // DEEPEST].stays]
        out = sorted({*self._closed([*self._next(states, name), *stays], depth), *stay})
        alive = [s for s in out if self._includes(s // DEEPEST)]
        everything = any(self.rules[r].exclude and pattern.pattern == _ALL for s in out for pattern, r in self.nodes[s // DEEPEST].rest)
        return out if alive and not everything else []

    def _includes(self, node: int) -> bool:
        """Whether an include rule can still match from a node on."""
        held = self.__dict__.setdefault("_held", {})
        if node not in held:
            n = self.nodes[node]
            held[node] = False
            held[node] = any(not self.rules[r].exclude for r in [*n.ends, *(r for _, r in n.rest)]) or any(self._includes(c) for c in [*n.names.values(), *(c for _, c in n.globs.values()), *(m for m in (n.deep, n.tail) if m >= 0)])
        return held[node]

    def match(self, states: Sequence[int], path: str) -> str | None:
        """The first include rule of a file in a folder with ``states``, unless an exclude rule matches too."""
        parts = path.split("/")
        found = {r for n in self._next(states, parts[-1]) for r in self.nodes[n].ends}
        for s in states:
            for pattern, r in self.nodes[s // DEEPEST].rest:
                if r not in found and pattern.search("/".join(parts[s % DEEPEST :])):
                    found.add(r)
        if any(self.rules[r].exclude for r in found):
            return None
        return self.rules[min(found)].name if found else None

    def of(self, path: str, known: dict[str, list[int]]) -> str | None:
        """The rule of a path; ``known`` remembers the folders' states."""
        folder = path.rpartition("/")[0]
        return self.match(self._states(folder, known), path)

    def _states(self, folder: str, known: dict[str, list[int]]) -> list[int]:
        if folder not in known:
            known[folder] = self.enter(self._states(folder.rpartition("/")[0], known), folder) if folder else self.root()
        return known[folder]


_ALL = glob_pattern("**")
#: Folders whose states a task remembers.
REMEMBERED = 100_000


def assign(files: DataFrame, rules: Sequence[Rule], path: str = "path") -> DataFrame:
    """``files`` with ``rule``, without those that no include rule takes or an exclude rule does."""
    trie = Trie(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known = {}
            batch = batch.assign(rule=[trie.of(p, known) if p is not None else None for p in batch[path]])
            yield batch[batch["rule"].notna()]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "rule")
    return files.drop("rule").mapInPandas(run, f"{schema}, rule string")


#: Shares of the files, one of which a task tests against the rules that say nothing of a file's name.
SHARES = 64
#: Stands for any first folder, as no folder has this name.
ANY = "/"


def _key(glob: str) -> tuple[str, str]:
    """The first folder of all paths that a glob matches, and what their names begin with; empty if the glob leaves it open."""
    *above, name = glob.split("/")
    wild = re.compile(r"[*?]")
    first = above[0] if above and not wild.search(above[0]) else ANY
    # a star pair that is a part of a component takes any number of components, the last one too
    open_ = name == "**" or any("**" in part and part != "**" for part in (*above, name))
    return first, "" if open_ else wild.split(name)[0]


def assign_of_table(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """As ``assign``, by ``rules(place, name, glob, exclude)``, a table of any length: the first rule is that of the least place.

    Files meet the rules of their first folder, or of any, whose names begin as theirs do, by one join on both. Rules that say
    nothing of the name meet all files below their first folder, each share of them in another task."""

    @F.pandas_udf("first string, begin string, pattern string")
    def keyed(globs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*_key(g), "(?s)" + glob_pattern(g)) for g in globs], columns=["first", "begin", "pattern"])

    known = rules.filter("glob is not null").select("place", "name", "exclude", keyed("glob").alias("said")).select("place", "name", "exclude", "said.*")
    shares = F.when(F.col("begin") == "", F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    known = known.select("place", "name", "exclude", "pattern", "first", "begin", F.explode(shares).alias("share"))

    parts, last = F.split("__path", "/"), F.substring_index("__path", "/", -1)
    firsts = F.when(F.size(parts) > 1, F.array(F.lit(ANY), parts[0])).otherwise(F.array(F.lit(ANY)))
    begins = F.transform(F.sequence(F.lit(0), F.length(last)), lambda n: last.substr(F.lit(1), n))
    paths = files.select(F.col(path).alias("__path")).filter("__path is not null").distinct()
    asked = paths.select("__path", begins.alias("begins"), F.explode(firsts).alias("first")).select("__path", "first", F.explode("begins").alias("begin"))
    share = F.when(F.col("begin") == "", F.pmod(F.xxhash64("__path"), F.lit(SHARES)).cast("int")).otherwise(F.lit(0))

    met = asked.withColumn("share", share).join(known, ["first", "begin", "share"]).filter(F.regexp_like("__path", "pattern"))
    include = F.when(~F.col("exclude"), F.struct("place", "name"))
    found = met.groupBy("__path").agg(F.max("exclude").alias("out"), F.min(include).alias("x")).filter("not out").select("__path", F.col("x.name").alias("rule"))
    return files.drop("rule").join(found, F.col(path) == F.col("__path")).drop("__path")
