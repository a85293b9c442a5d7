"""Parsers from files to documents, chunks, nodes and edges, run in tasks over batches of files.

A parser is a small function of one file; ``parse`` deals the files out and the results are three
tables. Markdown files, the most there are, are cut by Spark itself (``markdown``). Further parsers are registered by suffix, the first that fits is used.
"""

from __future__ import annotations

import ast
import json
import posixpath
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.functions import text as tx
from lorestone.model import HTTP_METHODS
from lorestone.operators.chunks import with_parent
from lorestone.operators.graph import one_each
from lorestone.operators.incremental import Rule, rule_labels
from lorestone.sources import markdown

BODY_CHARS = 800
RESULT = (
    "path string, document struct<id:string,label:string,properties:map<string,string>>, "
    "chunks array<struct<header_breadcrumb:string,content:string,chunk_level:int,chunk_index:int,kind:string,language:string,artifact_qualname:string,frontmatter:string>>, "
    "nodes array<struct<id:string,label:string,properties:map<string,string>>>, edges array<struct<from_id:string,to_id:string,rel_type:string,kind:string>>"
)


class Found:
    """What one file holds, as it is gathered."""

    def __init__(self, kb: str, path: str, language: str) -> None:
        self.kb, self.id, self.language = kb, f"{kb}::{path}", language
        self.properties: dict[str, str] = {"relative_path": path, "language": language}
        self.chunks: list[dict] = []
        self.nodes: list[dict] = []
        self.edges: list[dict] = []

    def chunk(self, crumb: str, content: str, level: int, kind: str, qualname: str | None = None, frontmatter: str | None = None) -> None:
        self.chunks.append({"header_breadcrumb": crumb, "content": content, "chunk_level": level, "chunk_index": len(self.chunks), "kind": kind, "language": self.language, "artifact_qualname": qualname, "frontmatter": frontmatter})

    def node(self, id_: str, label: str, **properties: str) -> str:
        self.nodes.append({"id": id_, "label": label, "properties": {k: str(v) for k, v in properties.items()}})
        return id_

    def edge(self, a: str, b: str, rel_type: str = "CONTAINS", kind: str | None = None) -> None:
        self.edges.append({"from_id": a, "to_id": b, "rel_type": rel_type, "kind": kind})

    def row(self, path: str) -> dict:
        return {"path": path, "document": {"id": self.id, "label": "Document", "properties": self.properties}, "chunks": self.chunks, "nodes": self.nodes, "edges": self.edges}


def _signature(n: ast.AST) -> str:
    if isinstance(n, ast.ClassDef):
        return f"class {n.name}({', '.join(map(ast.unparse, n.bases))})" if n.bases else f"class {n.name}"
    returns = f" -> {ast.unparse(n.returns)}" if n.returns else ""
    return f"{'async ' if isinstance(n, ast.AsyncFunctionDef) else ''}def {n.name}({ast.unparse(n.args)}){returns}"


def _imported(n: ast.Import | ast.ImportFrom, package: list[str]) -> list[str]:
    """Full names of the modules; dots lead up from the file's own package."""
    if isinstance(n, ast.Import):
        return [a.name for a in n.names]
    base = package[: len(package) - n.level + 1] if n.level else []
    return [".".join([*base, *([n.module] if n.module else [])]) or "."]


def python(text: str, kb: str, path: str, module: str | None = None) -> Found:
    """Module, its classes, functions and methods; imports and base classes as RELATES edges. A file
    that does not compile is its document and module alone. ``module``: its name below its package root."""
    found = Found(kb, path, "python")
    qual = module or re.sub(r"(^|\.)__init__$", "", re.sub(r"\.py$", "", path).replace("/", ".")) or path
    package = qual.split(".") if path.endswith("__init__.py") else qual.split(".")[:-1]
    module = found.node(f"{kb}::{qual}", "Module", name=qual.rpartition(".")[2], qualname=qual)
    found.edge(found.id, module)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        found.properties["valid"] = "false"
        found.chunk(qual, text[:BODY_CHARS], 1, "code", module)
        return found
    found.chunk(qual, (ast.get_docstring(tree) or text)[:BODY_CHARS], 1, "code", module)
    lines = text.split("\n")
    known = {n.name: f"{kb}::{qual}.{n.name}" for n in tree.body if isinstance(n, ast.ClassDef)}

    def symbol(n: ast.AST, owner: str, label: str, parent: str) -> str:
        name = f"{owner}.{n.name}"
        id_ = found.node(f"{kb}::{name}", label, name=n.name, qualname=name, signature=_signature(n), docstring=(ast.get_docstring(n) or "")[:BODY_CHARS], line=n.lineno)
        found.edge(parent, id_)
        found.chunk(name, "\n".join(lines[n.lineno - 1 : n.end_lineno])[:BODY_CHARS], 3 if label == "Method" else 2, "code", id_)
        return id_

    for n in tree.body:
        if isinstance(n, ast.Import | ast.ImportFrom):
            for name in _imported(n, package):
                found.edge(module, f"{kb}::__import__::{name}", "RELATES", "imports")
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            symbol(n, qual, "Function", module)
        elif isinstance(n, ast.ClassDef):
            class_id = symbol(n, qual, "Class", module)
            for base in n.bases:
                if isinstance(base, ast.Name | ast.Attribute):
                    name = ast.unparse(base)
                    target = known.get(name) or found.node(f"{kb}::__unresolved__::{name}", "Class", name=name.rpartition(".")[2], qualname=name)
                    found.edge(class_id, target, "RELATES", "inherits_from")
            for m in n.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    symbol(m, f"{qual}.{n.name}", "Method", class_id)
    return found


def _plain(value: Any, above: tuple[int, ...] = ()) -> Any:
    """The value as JSON can say it: keys and odd scalars are texts, and a value inside itself is cut off."""
    if id(value) in above:
        return "..."
    if isinstance(value, dict):
        return {str(k): _plain(v, (*above, id(value))) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v, (*above, id(value))) for v in value]
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def _refs(value: Any) -> set[str]:
    """All references in a plain value."""
    found, left = set(), [value]
    while left:
        x = left.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found.add(x["$ref"])
            left.extend(x.values())
        elif isinstance(x, list):
            left.extend(x)
    return found


def _ref_target(ref: str, kb: str, path: str) -> str:
    """The node a reference means: in this file, in another file of the knowledge base, or outside."""
    file, _, place = ref.partition("#")
    if re.match(r"[a-z][a-z0-9+.-]*:", file):
        return f"{kb}::__external__::{ref}"
    where = posixpath.normpath(posixpath.join(posixpath.dirname(path), file)) if file else path
    if where.startswith(".."):
        return f"{kb}::__external__::{ref}"
    name = place.rpartition("/")[2].replace("~1", "/").replace("~0", "~")
    return f"{kb}::{where}::components/schemas/{name}" if name else f"{kb}::{where}::spec"


def _said(value: Any) -> str:
    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


def openapi(text: str, kb: str, path: str) -> Found:
    """Operations and schemas of an API description, with references between them. Parts of a wrong shape are passed over."""
    found = Found(kb, path, "openapi")
    try:
        spec = yaml.safe_load(text)
    except Exception as e:  # noqa: BLE001  whatever the reader raises, the file is malformed
        found.properties |= {"valid": "false", "error": type(e).__name__}
        return found
    spec = _plain(spec)
    if not isinstance(spec, dict) or not ({"openapi", "swagger"} & spec.keys()):
        found.properties |= {"openapi": "false"} if isinstance(spec, dict) else {"valid": "false"}
        return found
    under = lambda value, key: v if isinstance(value, dict) and isinstance(v := value.get(key), dict) else {}
    root = found.node(f"{found.id}::spec", "OpenApiSpec", name=str(under(spec, "info").get("title", path)))
    found.edge(found.id, root)

    def relate(id_: str, value: Any) -> None:
        for target in sorted({_ref_target(ref, kb, path) for ref in _refs(value)} - {id_}):
            found.edge(id_, target, "RELATES", "references")

    for route, methods in under(spec, "paths").items():
        for method, operation in methods.items() if isinstance(methods, dict) else ():
            if method.lower() in HTTP_METHODS and isinstance(operation, dict):
                about = {"path": str(route), "method": method.lower(), "operation_id": str(operation.get("operationId") or ""), "summary": str(operation.get("summary") or "")}
                id_ = found.node(f"{found.id}::{route}::{method.lower()}", "OpenApiOperation", name=f"{method.upper()} {route}", **about)
                found.edge(root, id_)
                relate(id_, operation)
                found.chunk(f"{method.upper()} {route}", _said({"path": route, "method": method.lower(), **operation}), 2, "openapi_operation", id_)
    for name, schema in (under(under(spec, "components"), "schemas") or under(spec, "definitions")).items():
        shape = next((k for k in ("oneOf", "anyOf", "allOf") if k in schema), schema.get("type", "object")) if isinstance(schema, dict) else "scalar"
        id_ = found.node(f"{found.id}::components/schemas/{name}", "OpenApiSchema", name=name, shape=shape)
        found.edge(root, id_)
        relate(id_, schema)
        found.chunk(f"schemas/{name}", _said({name: schema}), 2, "openapi_schema", id_)
    return found


Parser = Callable[[str, str, str], Found]
#: Stands for Markdown files, which Spark cuts into sections.
SECTIONS = "sections"
#: Suffix pattern to parser, the first that fits.
PARSERS: list[tuple[str, Parser | str]] = [(r"(?i)\.(md|markdown)$", SECTIONS), (r"\.py$", python), (r"(?i)\.(ya?ml|json)$", openapi)]


def register(pattern: str, parser: Parser) -> None:
    PARSERS.append((pattern, parser))


def parse(files: DataFrame, kb: str, parsers: list[tuple[str, Parser | str]] | None = None) -> DataFrame:
    """One row a file that some parser takes, from ``files(path, content)`` and, if there is one, the column ``module``.

    A file that makes its parser fail is a document with ``valid`` false, and no other file suffers."""
    chosen = list(parsers or PARSERS)
    first = F.lit(None).cast("int")
    for k, (pattern, _) in reversed(list(enumerate(chosen))):
        first = F.when(F.col("path").rlike(pattern), k).otherwise(first)
    sections = [k for k, (_, parser) in enumerate(chosen) if parser == SECTIONS]
    own = F.coalesce(first.isin(sections), F.lit(False))
    files = files if "module" in files.columns else files.withColumn("module", F.lit(None).cast("string"))

    def one(path: str, content: str | bytes | None, module: str | None) -> dict | None:
        parser = next((p for pattern, p in chosen if re.search(pattern, path)), None)
        if parser is None:
            return None
        text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "replace")
        try:
            return (parser(text, kb, path, module or None) if parser is python else parser(text, kb, path)).row(path)
        except Exception as e:  # noqa: BLE001  whatever a parser raises
            found = Found(kb, path, "unknown")
            found.properties |= {"valid": "false", "error": type(e).__name__}
            return found.row(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(p, c, m if isinstance(m, str) else None) for p, c, m in zip(batch["path"], batch["content"], batch["module"], strict=True)]
            yield pd.DataFrame([r for r in rows if r], columns=["path", "document", "chunks", "nodes", "edges"])

    others = files.filter(first.isNotNull() & ~own).select("path", "content", "module").mapInPandas(run, RESULT)
    return others.union(markdown.parse(files.filter(own).select("path", "content"), kb).select(*others.columns))


def _ancestors(path: Column) -> Column:
    """The folders above a path, from the top; the first one is the empty name."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def package_roots(files: DataFrame) -> DataFrame:
    """``(root)``: the folders that hold a topmost package, one whose own folder is none."""
    folder = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
    packages = files.filter(F.col("path").rlike(r"(^|/)__init__\.py$")).select(folder.alias("folder")).filter("folder <> ''").distinct()
    up = F.regexp_extract("folder", r"^(?:(.*)/)?[^/]*$", 1)
    top = packages.withColumn("up", up).join(packages.select(F.col("folder").alias("up")), "up", "left_anti")
    return top.select(F.col("up").alias("root")).distinct()


def with_modules(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``files`` with ``module``, the dotted name below the nearest root above; the bare file name where there is none."""
    py = files.select("path").filter(F.col("path").rlike(r"\.py$")).distinct()
    near = py.withColumn("root", F.explode(_ancestors(F.col("path")))).join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    below = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    named = near.select("path", tx.module_name(below).alias("module"))
    stem = F.when(F.col("path").rlike(r"\.py$"), F.regexp_extract("path", r"([^/]*)\.py$", 1))
    return files.join(named, "path", "left").withColumn("module", F.coalesce("module", stem))


def chunks_of(parsed: DataFrame, rules: Sequence[Rule] = (), budget: int = tx.TOKEN_BUDGET) -> DataFrame:
    """Chunks of all documents: those over the budget are split again into numbered parts, chunks of level 3 know the last
    one of level 2 before them, and the first rule of the path gives the labels."""
    rows = parsed.select("path", F.col("document.id").alias("parent_document_id"), F.explode("chunks").alias("c")).select(F.col("path").alias("file_path"), "parent_document_id", "c.*")
    rows = rows.withColumn("p", F.explode(tx.resplit_parts(F.col("content"), F.col("header_breadcrumb"), budget)))
    rows = rows.withColumn("section_breadcrumb", F.col("header_breadcrumb")).withColumns({c: F.col(f"p.{c}") for c in ("part", "header_breadcrumb", "content", "content_type")}).drop("p")
    rows = rows.withColumn("chunk_index", F.row_number().over(W.partitionBy("file_path").orderBy("chunk_index", "part")) - 1).drop("part")
    rows = rows.withColumns({"labels": rule_labels(F.col("file_path"), rules), "chunk_id": tx.short_hash(F.col("file_path"), F.col("header_breadcrumb"), F.col("chunk_index").cast("string"))})
    return with_parent(rows, "file_path", "chunk_index", "chunk_level", "chunk_id")


def nodes_of(parsed: DataFrame, kb: str) -> DataFrame:
    both = parsed.select(F.explode(F.concat(F.array("document"), "nodes")).alias("n")).select("n.id", "n.label", F.lit(kb).alias("kb_name"), "n.properties")
    return one_each(both, ["id"])


def edges_of(parsed: DataFrame) -> DataFrame:
    """Edges; an import of a module that was parsed too points to it, any other to a placeholder."""
    edges = parsed.select(F.explode("edges").alias("e")).select("e.*").distinct()
    modules = parsed.select(F.explode("nodes").alias("n")).filter("n.label = 'Module'").select(F.col("n.id").alias("module")).distinct()
    want = F.replace("to_id", F.lit("::__import__::"), F.lit("::"))
    resolved = F.when(F.col("kind") != "imports", F.col("to_id")).when(F.col("module").isNotNull(), F.col("module")).otherwise(F.replace("to_id", F.lit("__import__"), F.lit("__external__")))
    return edges.join(modules, want == F.col("module"), "left").select("from_id", F.coalesce(resolved, "to_id").alias("to_id"), "rel_type", "kind")


def with_placeholders(nodes: DataFrame, edges: DataFrame, kb: str) -> DataFrame:
    """``nodes`` with one for every related thing that was not parsed, so that no relation is lost for want of an end."""
    label = F.when(F.col("kind") == "imports", "Module").when(F.col("kind") == "inherits_from", "Class").otherwise("OpenApiSchema")
    lacking = edges.filter("rel_type = 'RELATES'").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti").groupBy(F.col("to_id").alias("id")).agg(F.min(label).alias("label"))
    name = F.element_at(F.split("id", "::"), -1)
    return nodes.unionByName(lacking.select("id", "label", F.lit(kb).alias("kb_name"), F.create_map(F.lit("name"), name, F.lit("placeholder"), F.lit("true")).alias("properties")))


def payload(parsed: DataFrame) -> DataFrame:
    """What a graph takes of each file: nodes and edges, and of the chunks their number only."""
    return parsed.select("path", "document", "nodes", "edges", F.size("chunks").alias("chunks_count"))
