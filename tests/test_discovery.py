"""Discovery: ignore rules against git itself, the trie of rules against plain patterns, links and dead folders."""

from __future__ import annotations

import random
import re
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from lorestone.functions.text import glob_pattern
from lorestone.operators.incremental import Rule
from lorestone.sources import files, ignore
from lorestone.sources.rules import Trie, assign

IGNORES = {
    "": "# comment\n*.log\n!keep.log\n/build\nnode_modules/\nsub/*.tmp\n**/deep/x.txt\na/**/z.md\nout/**\n\\#odd\n[ab]?.py\n[!c]q.c\nlast \nesc\\ \n*.d/\n",
    "sub": "!*.log\nbuild/\n/only.txt\ndocs/**/draft*\n",
    "sub/docs": "*.md\n!keep.md\n",
}
NAMES = ["a.log", "keep.log", "build", "only.txt", "x.txt", "z.md", "keep.md", "draft1.md", "aa.py", "cc.py", "dq.c", "cq.c", "#odd", "last", "esc ", "t.tmp", "m.d", "n.md"]
FOLDERS = ["", "sub", "sub/docs", "sub/docs/in", "build", "sub/build", "node_modules/p", "a/b/c", "deep", "sub/deep", "out/in", "m.d", "keep.log.d"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "kb"
    for folder in FOLDERS:
        (root / folder).mkdir(parents=True, exist_ok=True)
    for folder in FOLDERS:
        for name in NAMES:
            if not (root / folder / name).exists():
                (root / folder / name).write_text(name)
    for folder, text in IGNORES.items():
        (root / folder / ".gitignore").write_text(text)
    return root


@pytest.mark.skipif(not shutil.which("git"), reason="git decides what is ignored")
def test_ignore_rules_agree_with_git(spark, tree):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tree, check=True, capture_output=True).stdout.decode()
    run("init", "-q")
    run("add", "-f", "node_modules/p/n.md", "a.log")
    want = set(run("ls-files", "--cached", "--others", "--exclude-standard", "-z").split("\0")) - {""}
    tracked = spark.createDataFrame([(p,) for p in run("ls-files", "-z").split("\0") if p], "path string")
    assert {r.path for r in files.listing(spark, str(tree), tracked=tracked).collect()} == want
    everything = files.listing(spark, str(tree), ignored=False)
    rules = spark.createDataFrame([r for folder, text in IGNORES.items() for r in ignore.rules_of(folder, text)], ignore.RULES)
    alone = {r.path for r in ignore.not_ignored(everything.select("path"), rules).collect()}
    assert alone == want - {"node_modules/p/n.md", "a.log"} and any(r.path.startswith(".git/") for r in everything.collect())


def test_links_and_dead_folders(spark, tree):
    (tree / "sub" / "loop").symlink_to(tree)
    (tree / "linked.md").symlink_to(tree / "n.md")
    plain = {str(p.relative_to(tree)) for p in tree.rglob("*") if p.is_file() and "loop" not in p.parts}
    assert {r.path for r in files.listing(spark, str(tree), ignored=False).collect()} == plain
    opened = spark.sparkContext.accumulator(0)
    rules = [Rule("no", "sub/**", exclude=True), Rule("md", "a/**/*.md"), Rule("top", "*.md"), Rule("not", "a/b/c/n.md", exclude=True)]
    found = {r.path: r.rule for r in files.listing(spark, str(tree), ignored=False, rules=rules, opened=opened).collect()}
    assert found == {p: "md" if "/" in p else "top" for p in plain if p.endswith(".md") and p != "a/b/c/n.md" and (p.startswith("a/") or "/" not in p)}
    assert opened.value == 4  # the root, a, a/b and a/b/c


def slowly(path, rules):
    hit = [r for r in rules if re.search(glob_pattern(r.glob), path, re.DOTALL)]
    return None if any(r.exclude for r in hit) else next((r.name for r in hit), None)


def test_trie_agrees_with_patterns(spark):
    rng = random.Random(2)
    parts = ["a", "b", "c.md", "*", "**", "*.md", "a*", "?", "**b", "a**c", "x.y", "**.md"]
    rules = [Rule(f"r{k}", "/".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 3, 4]))), rng.random() < 0.1) for k in range(60)]
    names = ["a", "b", "c.md", "d.md", "ab", "x.y", "xzy", ""]
    paths = sorted({"/".join(rng.choice(names[:-1]) for _ in range(rng.choice([1, 2, 3, 4, 5]))) for _ in range(400)})
    for chosen in ([r for r in rules if not r.exclude], rules, rules[:7], []):
        trie, known = Trie(chosen), {}
        assert {p: trie.of(p, known) for p in paths} == {p: slowly(p, chosen) for p in paths}
    table = spark.createDataFrame([(p, 1) for p in paths] + [(None, 2)], "path string, rule int").withColumn("more", F.lit("x"))
    assert {r.path: r.rule for r in assign(table, rules[:7]).collect()} == {p: slowly(p, rules[:7]) for p in paths if slowly(p, rules[:7])}


def test_settings_of_a_folder(tmp_path):
    root, general = tmp_path / "kb", tmp_path / "conf"
    (root / ".lorestone").mkdir(parents=True)
    general.mkdir()
    say = lambda path, text: path.write_text(text)
    uris = f"file://{root}", f"file://{general}"
    assert files.settings(*uris) == {"rules": [Rule("default", "**/*.md")]} and files.settings(uris[0]) == {"rules": [Rule("default", "**/*.md")]}
    say(general / "config.json", '{"version": 1, "name": "all", "graph": {"enabled": true}, "rules": [{"ruleName": "a", "match": {"glob": "*.a"}}, {"ruleName": "b", "match": {"glob": "*.b"}}]}')
    assert files.settings(*uris)["name"] == "all"
    say(root / ".lorestone" / "config.json", '[{"ruleName": "b", "match": {"glob": "*.bb"}}, {"ruleName": "c", "match": {"glob": "*.c"}}]')
    assert [(r.name, r.glob) for r in files.settings(*uris)["rules"]] == [("a", "*.a"), ("b", "*.bb"), ("c", "*.c")]
    say(root / "lorestone.json", '{"name": "own", "graph": null, "rules": []}')
    found = files.settings(*uris)
    assert (found["name"], found["graph"], len(found["rules"])) == ("own", {"enabled": True}, 2)
    say(root / ".lorestone.json", '{"rules": [{"ruleName": "z", "match": {"glob": "z"}, "exclude": true}]}')
    assert [r.name for r in files.settings(uris[0])["rules"]] == ["z"]
