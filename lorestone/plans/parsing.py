"""Registered queries that make files of the driver's tables and parse them, each with its SQL, and a few over stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestone.functions import text as tx
from lorestone.operators import chunks, graph, search, store
from lorestone.operators import incremental
from lorestone.operators.incremental import Rule
from lorestone.plans import guard
from lorestone.plans.catalogue import query, table
from lorestone.sources import ignore, parsers, rules

KB = "kb"


def files(spark: SparkSession, sf_dir: str, path: str, content: str) -> DataFrame:
    """A file a document; ``%d`` is its id, ``%l`` its language."""
    put = lambda t: F.replace(F.replace(F.lit(t), F.lit("%d"), F.col("doc_id").cast("string")), F.lit("%l"), F.coalesce("lang", F.lit("none")))
    return table(spark, sf_dir, "documents").select(put(path).alias("path"), put(content).alias("content"))


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = '---\n{"title": "T%d", "more": {"n": [1, 2]}}\n---\n# Top %l\n\nintro\n\n## Part %d\n\n```\n# no heading\n```\n\n### Deep\n\nend\n\n## Last\n\nbye'
    return parsers.parse(files(spark, sf_dir, "docs/%d.md", body), KB)


TOP = "'Top ' || coalesce(lang, 'none')"
PARTS = f"""(select doc_id, 'docs/' || doc_id || '.md' as path, {TOP} as top, unnest([
  {{'i': 0, 'crumb': {TOP}, 'level': 1, 'content': '# ' || {TOP} || chr(10) || chr(10) || 'intro'}},
  {{'i': 1, 'crumb': {TOP} || ' > Part ' || doc_id, 'level': 2, 'content': '## Part ' || doc_id || chr(10) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```'}},
  {{'i': 2, 'crumb': {TOP} || ' > Part ' || doc_id || ' > Deep', 'level': 3, 'content': '### Deep' || chr(10) || chr(10) || 'end'}},
  {{'i': 3, 'crumb': {TOP} || ' > Last', 'level': 2, 'content': '## Last' || chr(10) || chr(10) || 'bye'}}], recursive := true) from documents)"""


@query(f"""select path as file_path, i::int as chunk_index, crumb as header_breadcrumb, content, level::int as chunk_level, case when i = 1 then 'code' else 'text' end as content_type, 'kb::' || path as parent_document_id, 'T' || doc_id as title,
 case when doc_id % 10 = 3 then 'three' else 'doc' end as label, substring(sha256(path || ':' || crumb || ':' || i), 1, 16) as chunk_id, case when level = 3 then substring(sha256(path || ':' || top || ' > Part ' || doc_id || ':1'), 1, 16) end as parent_chunk_id from {PARTS}""")
def markdown_chunks(spark, sf_dir):  # A5 A8 B22 E2 E3 E8 H6 H7 H11
    rules = [Rule("three", "docs/*3.md", labels=("three",)), Rule("docs", "**/*.md", labels=("doc",))]
    rows = parsers.chunks_of(markdown_files(spark, sf_dir), rules)
    return rows.select("file_path", "chunk_index", "header_breadcrumb", "content", "chunk_level", "content_type", "parent_document_id", F.get_json_object("frontmatter", "$.title").alias("title"), F.col("labels")[0].alias("label"), "chunk_id", "parent_chunk_id")


@query(f"""select 'kb::' || path || '::' || crumb as id, 'MarkdownSection' as label, list_last(string_split(crumb, ' > ')) as name from {PARTS} union all select 'kb::docs/' || doc_id || '.md', 'Document', null from documents""")
def markdown_nodes(spark, sf_dir):  # A4 A5 K24
    return parsers.nodes_of(markdown_files(spark, sf_dir), KB).select("id", "label", F.col("properties")["name"].alias("name"))


@query(f"""select 'kb::' || path || case when i = 0 then '' when i = 2 then '::' || top || ' > Part ' || doc_id else '::' || top end as from_id, 'kb::' || path || '::' || crumb as to_id, 'CONTAINS' as rel_type from {PARTS}""")
def markdown_edges(spark, sf_dir):  # A5: every section is in the one above it
    return parsers.edges_of(markdown_files(spark, sf_dir)).select("from_id", "to_id", "rel_type")


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of one package below ``src``; of every tenth document the file does not compile."""
    code = '"""Module %d."""\nimport os\nfrom . import shared\n\n\nclass Base%d:\n    pass\n\n\nclass Own(Base%d, Far):\n    """Doc."""\n\n    def run(self, x: int = 1) -> int:\n        return x\n\n\nasync def go(*args):\n    return args\n'
    made = files(spark, sf_dir, "src/pkg/m%d.py", code)
    made = made.withColumn("content", F.when(F.col("path").like("%0.py"), "def (").otherwise(F.col("content")))
    made = made.unionByName(spark.createDataFrame([("src/pkg/__init__.py", "")], "path string, content string"))
    return parsers.parse(parsers.with_modules(made, parsers.package_roots(made)), KB)


GOOD = "from documents where doc_id % 10 <> 0"


@query(f"""select distinct id, label, name, signature, placeholder from (
select 'kb::src/pkg/m' || doc_id || '.py' as id, 'Document' as label, null as name, null as signature, null as placeholder from documents
union all select 'kb::pkg.m' || doc_id, 'Module', 'm' || doc_id, null, null from documents
union all select 'kb::src/pkg/__init__.py', 'Document', null, null, null union all select 'kb::pkg', 'Module', 'pkg', null, null
union all select 'kb::pkg.m' || doc_id || '.Base' || doc_id, 'Class', 'Base' || doc_id, 'class Base' || doc_id, null {GOOD}
union all select 'kb::pkg.m' || doc_id || '.Own', 'Class', 'Own', 'class Own(Base' || doc_id || ', Far)', null {GOOD}
union all select 'kb::pkg.m' || doc_id || '.Own.run', 'Method', 'run', 'def run(self, x: int=1) -> int', null {GOOD}
union all select 'kb::pkg.m' || doc_id || '.go', 'Function', 'go', 'async def go(*args)', null {GOOD}
union all select 'kb::__unresolved__::Far', 'Class', 'Far', null, null {GOOD}
union all select 'kb::__external__::os', 'Module', 'os', null, 'true' {GOOD})""")
def python_nodes(spark, sf_dir):  # A4 A6 A6a A6b A34 H18 H19 H20 H22: symbols with signatures, and placeholders for what is not there
    parsed = python_files(spark, sf_dir)
    nodes = parsers.with_placeholders(parsers.nodes_of(parsed, KB), parsers.edges_of(parsed), KB)
    return nodes.select("id", "label", *[F.col("properties")[k].alias(k) for k in ("name", "signature", "placeholder")])


@query(f"""select 'kb::src/pkg/m' || doc_id || '.py' as from_id, 'kb::pkg.m' || doc_id as to_id, 'CONTAINS' as rel_type, null as kind from documents
union all select 'kb::src/pkg/__init__.py', 'kb::pkg', 'CONTAINS', null
union all select 'kb::pkg.m' || doc_id, 'kb::pkg.m' || doc_id || unnest(['.Base' || doc_id, '.Own', '.go']), 'CONTAINS', null {GOOD}
union all select 'kb::pkg.m' || doc_id || '.Own', 'kb::pkg.m' || doc_id || '.Own.run', 'CONTAINS', null {GOOD}
union all select 'kb::pkg.m' || doc_id, unnest(['kb::__external__::os', 'kb::pkg']), 'RELATES', 'imports' {GOOD}
union all select 'kb::pkg.m' || doc_id || '.Own', unnest(['kb::pkg.m' || doc_id || '.Base' || doc_id, 'kb::__unresolved__::Far']), 'RELATES', 'inherits_from' {GOOD}""")
def python_edges(spark, sf_dir):  # A6c H20 H21 H23: imports of parsed modules resolve, others are external
    return parsers.edges_of(python_files(spark, sf_dir)).select("from_id", "to_id", "rel_type", "kind")


def openapi_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API descriptions; of every tenth document the paths are of a wrong shape."""
    spec = (
        '{"openapi": "3.0.0", "info": {"title": "API %d"}, "paths": {"/x": {"GET": {"operationId": "op%d", "summary": "Gets %l", "a": [{"$ref": "#/components/schemas/S%d"}, {"$ref": "#/components/schemas/S%d"}]}, "note": {}}}, '
        '"components": {"schemas": {"S%d": {"type": "object", "p": {"$ref": "../lib/c.yaml#/components/schemas/O"}}, "U": {"oneOf": [{"$ref": "https://far.example/s.json#/A"}]}}}}'
    )
    made = files(spark, sf_dir, "api/%d.json", spec)
    odd = '{"openapi": "3.0.0", "info": "none", "paths": {"/x": ["get"]}, "components": []}'
    return parsers.parse(made.withColumn("content", F.when(F.col("path").like("%0.json"), odd).otherwise(F.col("content"))), KB)


ID = "'kb::api/' || doc_id || '.json"


@query(f"""select {ID}' as id, 'Document' as label, null as name, null as shape from documents
union all select {ID}::spec', 'OpenApiSpec', case when doc_id % 10 = 0 then 'api/' || doc_id || '.json' else 'API ' || doc_id end, null from documents
union all select {ID}::/x::get', 'OpenApiOperation', 'GET /x', null {GOOD}
union all select {ID}::components/schemas/S' || doc_id, 'OpenApiSchema', 'S' || doc_id, 'object' {GOOD}
union all select {ID}::components/schemas/U', 'OpenApiSchema', 'U', 'oneOf' {GOOD}""")
def openapi_nodes(spark, sf_dir):  # A7 A7a A7b A7c H26 H27 H29
    return parsers.nodes_of(openapi_files(spark, sf_dir), KB).select("id", "label", F.col("properties")["name"].alias("name"), F.col("properties")["shape"].alias("shape"))


@query(f"""select {ID}' as from_id, {ID}::spec' as to_id, null as kind from documents
union all select {ID}::spec', {ID}::' || unnest(['/x::get', 'components/schemas/S' || doc_id, 'components/schemas/U']), null {GOOD}
union all select {ID}::/x::get', {ID}::components/schemas/S' || doc_id, 'references' {GOOD}
union all select {ID}::components/schemas/S' || doc_id, 'kb::lib/c.yaml::components/schemas/O', 'references' {GOOD}
union all select {ID}::components/schemas/U', 'kb::__external__::https://far.example/s.json#/A', 'references' {GOOD}""")
def openapi_edges(spark, sf_dir):  # A7 H24 H25: references to this file, to others and outside, each once
    return parsers.edges_of(openapi_files(spark, sf_dir)).select("from_id", "to_id", "kind")


@query("""select 'p/' || doc_id || '.proto' as path, case when doc_id % 10 = 0 then 'false' end as valid, case when doc_id % 10 = 0 then 0 else 1 end::int as chunks_count from documents""")
def custom_parser(spark, sf_dir):  # A4 J1 K24: a further parser; a file that it fails on is a document that is not valid
    def proto(text: str, kb: str, path: str) -> parsers.Found:
        found = parsers.Found(kb, path, "protobuf")
        found.chunk(path, {"message": text}[text.split()[0]], 1, "code")
        return found

    made = files(spark, sf_dir, "p/%d.proto", "message M%d").withColumn("content", F.when(F.col("path").like("%0.proto"), "oops").otherwise(F.col("content")))
    parsed = parsers.parse(made, KB, [*parsers.PARSERS, (r"\.proto$", proto)])
    return parsers.payload(parsed).select("path", F.col("document.properties")["valid"].alias("valid"), F.col("chunks_count").cast("int").alias("chunks_count"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), F.coalesce("source", F.lit("")).alias("peer"), F.lit("").alias("language"), F.col("lang"), "text", "doc_id")


@query("""select 'd' || doc_id as file_path, nullif(coalesce(source, ''), '') as peer, null::varchar as language from documents""")
def empty_as_null(spark, sf_dir):  # B17
    return store.restored(stored(spark, sf_dir), ["peer", "language"]).select("file_path", "peer", "language")


@query("""select 'd' || doc_id as file_path, lang from documents where doc_id not in (1, 2, 5)""")
def delete_listed(spark, sf_dir):  # A14 B4: a list of documents is deleted
    gone = spark.createDataFrame([("d1",), ("d2",), ("d5",), ("d5",), ("none",)], "file_path string")
    return store.delete(stored(spark, sf_dir), gone, ["file_path"]).select("file_path", "lang")


@query("""select 'd' || doc_id as file_path, text as content, 1::bigint as chunk_count from documents where doc_id = 7 and source = (select source from documents where doc_id = 7)""")
def document_of_peer(spark, sf_dir):  # B2 M5: a document of one peer, by its name
    rows = stored(spark, sf_dir)
    peer = rows.filter("doc_id = 7").select("peer").first()[0]
    return chunks.get_document(rows, "file_path", "doc_id", "text", (F.col("file_path") == "d7") & (F.col("peer") == peer))


@query("""with l as (select l_orderkey as id from lineitem union all select -l_partkey from lineitem), g as (select id, count(*) as n from l group by id)
select o_orderkey, o_orderpriority, coalesce(n, 0) as degree from orders left join g on id = o_orderkey""")
def documents_with_degree(spark, sf_dir):  # C16: orders without a link count none
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("from_id"), (-F.col("l_partkey")).alias("to_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(graph.degree(edges).withColumnRenamed("id", "o_orderkey"), "o_orderkey", "left").select("o_orderkey", "o_orderpriority", F.coalesce("degree", F.lit(0)).alias("degree"))


#: Texts that may not run over a table ``t``, and texts that may.
REFUSED = (
    "drop table t", "insert into t select * from t", "delete from t", "call x()", "refresh table t", "load data inpath 'x' into table t", "replace table t as select 1", "set a = 1", "create view v as select * from t",
    "with a as (select 1) insert into t select * from a", "select * from other", "select * from parquet.`/etc`", "select (select max(a) from other) from t", "select reflect('java.lang.System', 'exit', 1) from t", "explain select * from t",
    "select transform(a) using 'cat' from t", "show tables", "truncate table t", "select 1; drop table t", "from t insert into x select a",
)
ALLOWED = ("select 'set' as a from t", "select * from t where kind = 'delete'", "with u as (select * from t) select * from u join t using (a)", "select offset from t", "select `drop` from t", "from t |> where a > 1", "select a from t where a in (select b from t)", "values (1)")


@query(
    "select * from (values " + ", ".join(f"('{'r' if k < len(REFUSED) else 'a'}{k if k < len(REFUSED) else k - len(REFUSED)}', {'true' if k < len(REFUSED) else 'false'})" for k in range(len(REFUSED) + len(ALLOWED))) + ") v(name, refused) "
    "union all select source, false from documents where lang = 'en' group by source having count(*) > 3"
)
def guarded_sql(spark, sf_dir):  # B13 F7 J4: which texts are refused; reads with parameters pass
    def refused(text: str) -> bool:
        try:
            guard.check(spark, text, ["t"])
        except guard.Refused:
            return True
        return False

    rows = [(f"{k}{i}", refused(t)) for k, texts in (("r", REFUSED), ("a", ALLOWED)) for i, t in enumerate(texts)]
    language, _ = search.checked_request("en")
    read = guard.run(spark, "select source from {documents} where lang = :lang group by source having count(*) > 3", {"lang": language}, documents=table(spark, sf_dir, "documents"))
    return spark.createDataFrame(rows, "name string, refused boolean").union(read.select("source", F.lit(False)))


@query("""select distinct 'node' as what, 'n' || n_nationkey as a, n_name as b, 'kb' as kind from nation union all select 'node', 'r' || r_regionkey, 'r' || r_regionkey, 'unknown' from region
union all select 'edge', 'r' || n_regionkey, 'n' || n_nationkey, 'holds' from nation""")
def guarded_graph(spark, sf_dir):  # J4 K25: a query's cells as nodes, each once, and edges; the federation's own node is none
    cells = guard.run(spark, """
      with n as (select 'n' || n_nationkey as id, n_name as label, 'kb' as kind, cast(null as string) as source, cast(null as string) as target from {nation})
      select * from n union all select * from n
      union all select 'r' || r_regionkey, null, null, null, null from {region}
      union all select 'federation', 'Federation', 'kb', null, null
      union all select null, null, 'holds', 'r' || n_regionkey, 'n' || n_nationkey from {nation}""", nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))  # fmt: skip
    nodes, edges = graph.graph_shape(cells)
    return nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("label").alias("b"), "kind").union(edges.select(F.lit("edge"), "source", "target", "kind"))


@query("""with n as (select 'c' || c_custkey as id, case c_custkey % 3 when 0 then 'document' when 1 then 'kb' else 'class' end as kind, c_custkey as k from customer)
select a.id as from_id, b.id as to_id from n a join n b on b.k = a.k + 3 where a.kind in ('document', 'kb') and b.kind in ('document', 'kb')
union all select a.id, b.id from n a join n b on b.k = a.k + 1 where a.kind = 'document' and b.kind = 'kb'""")
def kinds_shown(spark, sf_dir):  # B14: of the graph, documents and knowledge bases with the edges between them
    c = table(spark, sf_dir, "customer").select("c_custkey")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    k = F.col("c_custkey")
    nodes = c.select(name(k).alias("id"), F.when(k % 3 == 0, "document").when(k % 3 == 1, "kb").otherwise("class").alias("kind"))
    edges = c.select(name(k).alias("from_id"), F.explode(F.array(name(k + 1), name(k + 3))).alias("to_id"))
    return graph.kind_view(nodes, edges)[1].select("from_id", "to_id")


@query("""with f as (select distinct 'd' || doc_id % 50 || '/a/b/f' || doc_id % 2500 || '.md' as path, doc_id % 50 as d, doc_id % 2500 as n from documents),
m as (select path, d, p_partkey as k from f left join part on p_partkey = n and p_partkey % 40 = d)
select path, case when k is null then 'rest' else 'r' || k end as rule from m where coalesce(k % 11 <> 0, d = 1 or d between 10 and 19)""")
def many_rules(spark, sf_dir):  # A1 B9 C4: a rule a part, and one after all these
    k = F.col("p_partkey")
    glob = F.concat(F.lit("d"), (k % 40).cast("string"), F.lit("/**/f"), k.cast("string"), F.lit(".*"))
    listed = table(spark, sf_dir, "part").select(F.struct(F.lit(0).alias("late"), k.alias("key")).alias("place"), F.concat(F.lit("r"), k.cast("string")).alias("name"), glob.alias("glob"), (k % 11 == 0).alias("exclude"))
    rest = spark.range(1).select(F.struct(F.lit(1).alias("late"), F.col("id").alias("key")).alias("place"), F.lit("rest").alias("name"), F.lit("d1*/**").alias("glob"), F.lit(False).alias("exclude"))
    name = F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string"), F.lit("/a/b/f"), (F.col("doc_id") % 2500).cast("string"), F.lit(".md"))
    return rules.assign_of_table(table(spark, sf_dir, "documents").select(name.alias("path")).distinct(), listed.union(rest))


@query("""with f as (select doc_id as i, doc_id % 5 as d, doc_id % 3 as s, coalesce(lang, 'none') as e from documents)
select 'd' || d || '/s' || s || '/f' || i || '.' || e as path from f where not (d = 2 and s = 1) and case when d = 3 and i = 10 then true when d = 3 and i % 10 = 0 then false when e = 'de' then d = 1 else true end""")
def ignored_paths(spark, sf_dir):  # A2 C3: the last rule that matches wins, deeper files' rules come later, and nothing comes back from an ignored folder
    d = table(spark, sf_dir, "documents")
    path = F.format_string("d%d/s%d/f%d.%s", F.col("doc_id") % 5, F.col("doc_id") % 3, F.col("doc_id"), F.coalesce("lang", F.lit("none")))
    texts = {"": "*.de\n!d1/**/*.de\n/d2/s1/\n", "d2/s1": "!*\n", "d3": "f*0.*\n!f10.*\n"}
    known = spark.createDataFrame([r for folder, text in texts.items() for r in ignore.rules_of(folder, text)], ignore.RULES)
    return ignore.not_ignored(d.select(path.alias("path")), known)
