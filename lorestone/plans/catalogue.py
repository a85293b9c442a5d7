"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorestone.functions import text as tx
from lorestone.functions import variants
from lorestone.model import EDGES
from lorestone.operators import chunks, graph, incremental, kb, search, store, sync
from lorestone.sources import scratch
from lorestone.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_at(rows: DataFrame) -> list[Column]:
    """A row's place in storage: its file and its place there, which no split of the file changes."""
    return [rows["_metadata.file_path"], rows["_metadata.row_index"]]


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The search's query: one row, by a pushed-down filter."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def vectors_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return v.join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")


DISTANCE = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6)"
NEAR = f"from embeddings e cross join (select embedding from embeddings where vec_id = 0) q"


@query(f"select e.vec_id, {DISTANCE} as distance, round(1 / (1 + {DISTANCE}), 6) as score {NEAR} order by distance, vec_id limit 10")
def search_topk(spark, sf_dir):  # F1 B16 H17
    hits = search.top_k(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), "vec_id", 10, "embedding")
    return hits.select("vec_id", "distance", "score")


@query(f"select d.doc_id, {DISTANCE} as distance, round(1 / (1 + {DISTANCE}), 6) as score, substring(d.text, 1, 200) as excerpt {NEAR} join documents d on d.doc_id = e.vec_id where d.lang = 'en' order by distance, d.doc_id limit 10")
def search_filtered(spark, sf_dir):  # M1 C14 F9
    rows = vectors_with_documents(spark, sf_dir).filter("lang = 'en'")
    hits = search.top_k(rows, first_vector(spark, sf_dir), "doc_id", 10, "embedding")
    return hits.select("doc_id", "distance", "score", search.excerpt(F.col("text")).alias("excerpt"))


@query("""select doc_id, source from documents where '["' || source || '","' || lang || '"]' like '%rc1%'""")
def search_label_like(spark, sf_dir):  # B5: substring of the labels' JSON
    labels = F.to_json(F.array("source", "lang"))
    return table(spark, sf_dir, "documents").filter(search.label_like(labels, "rc1")).select("doc_id", "source")


@query(f"""with hits as (select e.vec_id, d.source, {DISTANCE} as distance {NEAR} join documents d on d.doc_id = e.vec_id order by distance, e.vec_id limit 50)
select source, vec_id as doc_id, distance from hits qualify row_number() over (partition by source order by distance, vec_id) = 1""")
def search_documents_dedup(spark, sf_dir):  # M2 E1
    hits = search.top_k(vectors_with_documents(spark, sf_dir), first_vector(spark, sf_dir), "doc_id", 50, "embedding")
    return search.best_per_document(hits, "source", "doc_id").select("source", "doc_id", "distance")


@query("select count(*) as chunk_count, count(distinct conv_id) as document_count from conversations")
def chunk_and_document_count(spark, sf_dir):  # D1 D2
    return table(spark, sf_dir, "conversations").agg(F.count("*").alias("chunk_count"), F.count_distinct("conv_id").alias("document_count"))


@query("select conv_id, count(*) as chunk_count, arg_min(role, turn) as role from conversations group by conv_id")
def list_documents(spark, sf_dir):  # D3 M3
    return chunks.list_documents(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role"])


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn, text) as content, count(*) as chunk_count from conversations group by conv_id")
def get_document(spark, sf_dir):  # D4 F2
    return chunks.get_document(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn, text) as content, count(*) as chunk_count, min(turn % 3 + 1) filter (turn = first) as level from (select *, min(turn) over (partition by conv_id) as first from conversations where role = 'assistant') group by conv_id")
def get_section(spark, sf_dir):  # D6 B3
    rows = table(spark, sf_dir, "conversations").withColumn("level", F.col("turn") % 3 + 1)
    return chunks.get_document(rows, "conv_id", "turn", "text", F.col("role") == "assistant", ["level"])


@query("select doc_id from documents where list_has_all([lang, source], ['en', 'src3'])")
def list_documents_all_labels(spark, sf_dir):  # B6 G6
    return table(spark, sf_dir, "documents").filter(search.has_labels(F.array("lang", "source"), ["en", "src3"])).select("doc_id")


@query("""select doc_id, len(regexp_extract_all(text, '\\S+'))::int as token_count, case when doc_id % 2 = 0 then 'T' || doc_id else source || '.md' end as title,
  array_to_string(case when doc_id % 3 = 0 then ['a', 'b'] when doc_id % 3 = 1 then ['x', lang] else ['l', lang] end, '|') as tags from documents""")
def document_metadata(spark, sf_dir):  # B19 B20 B21 H39
    d = table(spark, sf_dir, "documents")
    tags = F.when(F.col("doc_id") % 3 == 0, F.lit('"tags": " a, b ,"')).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"tags": ["x", "'), "lang", F.lit('"]')))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"title": "T'), F.col("doc_id").cast("string"), F.lit('"')))
    front = F.concat(F.lit("{"), F.concat_ws(", ", head, tags), F.lit("}"))
    said = tx.tags(front, F.array(F.lit("l"), "lang"))
    return d.select("doc_id", tx.word_count(F.col("text")).alias("token_count"), tx.title(front, F.concat(F.lit("docs/"), "source", F.lit(".md"))).alias("title"), F.array_join(said, "|").alias("tags"))


MD = """select conv_id, turn, role, (case when turn % 3 = 2 then '### ' else '## ' end) || role || chr(10) || chr(10)
  || (case when turn % 5 = 4 then '```' || chr(10) || text || chr(10) || '```' else text end)
  || (case when (conv_id + turn) % 7 = 6 then chr(10) || chr(10) || '| a | b |' || chr(10) when (conv_id + turn) % 7 = 5 then chr(10) || '||' || chr(10) else '' end) as md,
  case when turn % 3 = 2 then 3 else least(turn % 3 + 1, 2) end as lvl from conversations"""


def markdown_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, turn = table(spark, sf_dir, "conversations"), F.col("turn")
    body = F.when(turn % 5 == 4, F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    grid = F.when((F.col("conv_id") + turn) % 7 == 6, "\n\n| a | b |\n").when((F.col("conv_id") + turn) % 7 == 5, "\n||\n").otherwise("")
    md = F.concat(F.when(turn % 3 == 2, "### ").otherwise("## "), "role", F.lit("\n\n"), body, grid)
    return c.select("conv_id", "turn", "role", md.alias("md"), F.when(turn % 3 == 2, 3).otherwise(F.least(turn % 3 + 1, F.lit(2))).cast("int").alias("lvl"))


@query(f"""select conv_id, turn, case when contains(md, '```') and regexp_matches(md, '(?m)^\\|.+\\|') then 'mixed' when contains(md, '```') then 'code'
  when regexp_matches(md, '(?m)^\\|.+\\|') then 'table' else 'text' end as content_type from ({MD})""")
def content_type(spark, sf_dir):  # H7
    return markdown_view(spark, sf_dir).select("conv_id", "turn", tx.content_type(F.col("md")).alias("content_type"))


@query("select doc_id, length(text) // 4 as tokens, length(text) // 4 > 1900 as over_budget from documents")
def token_estimate(spark, sf_dir):  # H1
    tokens = tx.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), (tokens > tx.TOKEN_BUDGET).alias("over_budget"))


@query("""select doc_id, (generate_subscripts(p, 1) - 1)::int as part, unnest(p) as content from (
  select doc_id, list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda x: trim(x, chr(10) || ' ') <> '') as p from documents)""")
def split_paragraphs(spark, sf_dir):  # H2
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(tx.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("part", "content"))


@query("""select doc_id, (generate_subscripts(p, 1) - 1)::int as part, unnest(p) as content from (
  select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(10) || ' ') <> '') as p from documents)""")
def split_sentences(spark, sf_dir):  # H3
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("part", "content"))


@query("""select doc_id, i::int as part, substring(text, i * 7600 + 1, 7600) as content from documents, lateral (select unnest(range(0, (length(text) + 7599) // 7600)) as i)""")
def hard_split(spark, sf_dir):  # H5 E8
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.hard_split(F.col("text"))).alias("part", "content"))


@query("""with recursive base as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(10) || ' ') <> '') as p from documents),
fold(doc_id, p, i, part, used) as (
  select doc_id, p, 1, 0, length(p[1]) // 4 from base where len(p) > 0
  union all
  select doc_id, p, i + 1, case when used + length(p[i + 1]) // 4 > 1900 then part + 1 else part end,
    case when used + length(p[i + 1]) // 4 > 1900 then length(p[i + 1]) // 4 else used + length(p[i + 1]) // 4 end from fold where i < len(p))
select doc_id, part::int as part, string_agg(p[i], ' ' order by i) as content from fold group by doc_id, part""")
def merge_sentences(spark, sf_dir):  # H4 E6: a fold whose sum starts anew
    merged = tx.greedy_merge(tx.sentences(F.col("text")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(merged).alias("part", "content"))


@query()
def resplit(spark, sf_dir):  # H6: checked against a model in Python by the tests
    d = table(spark, sf_dir, "documents")
    parts = d.select("doc_id", F.posexplode(tx.resplit(F.col("text"))).alias("part", "content"))
    return parts.withColumn("part_id", tx.short_hash(F.col("doc_id").cast("string"), F.concat(F.lit("#part-"), (F.col("part") + 1).cast("string"))))


@query("select doc_id, substring(sha256(source || ':' || lang || ':' || doc_id::varchar), 1, 16) as chunk_id from documents")
def chunk_ids(spark, sf_dir):  # H8
    return table(spark, sf_dir, "documents").select("doc_id", tx.short_hash(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("chunk_id"))


@query(f"""select conv_id, turn, crumb, case when crumb = 'Document' then 1 else least(len(string_split(crumb, ' > ')), 3) end::int as level from (
  select conv_id, turn, array_to_string(case when h = parents[-1] then parents else list_append(parents, h) end, ' > ') as crumb from (
    select conv_id, turn, regexp_extract(md, '(?m)^#+\\s+(.+)', 1) as h, case when lvl = 3 then ['Top', 'user'] when lvl = 2 then ['Top'] else []::varchar[] end as parents from ({MD})))""")
def breadcrumb_level(spark, sf_dir):  # H9 H10
    parents = F.when(F.col("lvl") == 3, F.array(F.lit("Top"), F.lit("user"))).when(F.col("lvl") == 2, F.array(F.lit("Top"))).otherwise(F.array().cast("array<string>"))
    crumb = tx.breadcrumb(parents, tx.first_heading(F.col("md")))
    return markdown_view(spark, sf_dir).select("conv_id", "turn", crumb.alias("crumb")).withColumn("level", tx.level(F.col("crumb")).cast("int"))


@query(f"""select conv_id, turn, case when lvl = 3 then last_value(case when lvl = 2 then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) end as parent_turn from ({MD})""")
def parent_assignment(spark, sf_dir):  # E3
    return chunks.with_parent(markdown_view(spark, sf_dir), "conv_id", "turn", "lvl", "turn").select("conv_id", "turn", F.col("parent_chunk_id").alias("parent_turn"))


@query(f"""with g as (select *, sum(case when lvl <= 2 then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as grp, row_number() over (partition by conv_id order by turn) as rn from ({MD}))
select conv_id, min(turn) as turn, string_agg(md, chr(10) || chr(10) order by turn) as content from g group by conv_id, case when grp = 0 then -rn else grp end""")
def merge_level_3(spark, sf_dir):  # E4
    rows = chunks.merge_level_3(markdown_view(spark, sf_dir), "conv_id", "turn", "lvl", "md")
    return rows.select("conv_id", "turn", F.col("md").alias("content"))


@query(f"""with v as (select * from ({MD})) select a.conv_id, a.turn, (select max(b.turn) from v b where b.conv_id = a.conv_id and b.turn < a.turn and b.lvl < a.lvl) as parent from v a""")
def section_tree(spark, sf_dir):  # E5
    return chunks.section_parent(markdown_view(spark, sf_dir), "conv_id", "turn", "lvl", "turn").select("conv_id", "turn", "parent")


@query("""with old as (select doc_id, case when doc_id % 7 = 0 then 'x' else sha256(text) end as h, case when doc_id % 5 = 0 then 1 else 0 end as m from documents where doc_id % 3 <> 0
  union all select doc_id + 1000000, sha256(text), 0 from documents where doc_id % 11 = 0),
new as (select doc_id, sha256(text) as h, 0 as m from documents)
select coalesce(n.doc_id, o.doc_id) as path, case when n.doc_id is null then 'deleted' when o.doc_id is null then 'new' when n.m = o.m then 'same_time' when n.h = o.h then 'same_content' else 'changed' end as state
from new n full join old o using (doc_id)""")
def discover_diff(spark, sf_dir):  # C1 C2 A3
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    old = d.filter("path % 3 <> 0").select("path", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("path") % 5 == 0, 1).otherwise(0).alias("mtime"))
    gone = d.filter("path % 11 = 0").select((F.col("path") + 1_000_000).alias("path"), "content_hash", F.lit(0).alias("mtime"))
    return incremental.diff_files(d.withColumn("mtime", F.lit(0)), old.unionByName(gone))


RULES = (
    incremental.Rule("drafts", "https://*/**/draft*", exclude=True),
    incremental.Rule("example", "https://*.example.com/**/*"),
    incremental.Rule("secure", "https://**/*"),
    incremental.Rule("rest", "**/*"),
)


@query("""select page_id, case when regexp_full_match(url, 'https://[^/]*\\.example\\.com/(.*/)?[^/]*') then 'example' when regexp_full_match(url, 'https://.*') then 'secure' else 'rest' end as rule
from pages where not regexp_full_match(url, 'https://[^/]*/(.*/)?draft[^/]*')""")
def first_match_rule(spark, sf_dir):  # B7 B8 B9
    return incremental.assign_rules(table(spark, sf_dir, "pages"), RULES, "url").select("page_id", "rule")


@query("""with cache as (select distinct sha256(text) as h from documents where doc_id % 3 <> 0)
select d.doc_id, sha256(d.text) as content_hash, c.h is not null as hit from documents d left join cache c on c.h = sha256(d.text)""")
def cache_lookup_split(spark, sf_dir):  # C5 H15 A20
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = d.filter("doc_id % 3 <> 0").select(F.sha2("text", 256).alias("content_hash")).distinct()
    cache = cache.select("content_hash", F.lit("hash").alias("model"), F.lit(1).alias("dimensions"), F.array(F.lit(0.0)).alias("vector"))
    return incremental.cache_lookup(d, cache, "hash", 1).select("doc_id", "content_hash", "hit")


@query("select lang as model, count(*) as entries, (sum(doc_id % 3) * 4)::bigint as bytes from documents group by rollup(lang)")
def cache_stats(spark, sf_dir):  # D5
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("model"), F.array_repeat(F.lit(0.0), (F.col("doc_id") % 3).cast("int")).alias("vector"))
    return incremental.cache_stats(d)


@query("select event_id from events where ts >= timestamp '2024-01-30' - interval 7 day")
def cache_prune(spark, sf_dir):  # A23
    rows = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("accessed_at"))
    kept = incremental.cache_prune(rows, 7 * 86_400_000, F.unix_millis(F.to_timestamp(F.lit("2024-01-30 00:00:00"))))
    return kept.select("event_id")


@query("""select o_orderkey as job_id, (o_totalprice::bigint % 50)::bigint as cache_hits, (o_custkey % 7)::bigint as cache_misses,
  round((o_totalprice::bigint % 50)::double / nullif((o_totalprice::bigint % 50) + o_custkey % 7, 0), 6) as cache_hit_rate from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 1""")
def cache_hit_rate(spark, sf_dir):  # D8: of the latest finished job
    whole = F.round("o_totalprice").cast("bigint")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("finished_at"), (whole % 50).alias("cache_hits"), (F.col("o_custkey") % 7).cast("bigint").alias("cache_misses"))
    return incremental.last_finished_job(jobs).select("job_id", "cache_hits", "cache_misses", F.round("cache_hit_rate", 6).alias("cache_hit_rate"))


@query("""select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def manifest_latest(spark, sf_dir):  # A17 E7: the manifest's rows of known users are replaced by later ones
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    order = [F.desc("ts"), F.desc("event_id")]
    known = incremental.latest(e.filter("event_id % 3 = 0"), ["user_id"], order)
    return incremental.upsert(known, incremental.latest(e, ["user_id"], order), ["user_id"])


@query("select p_partkey, p_name from part where p_brand = (select min(p_brand) from part) and starts_with(p_type, 'S') order by p_partkey limit 50")
def find_artifacts(spark, sf_dir):  # B11 F3 K4
    part = table(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_name"), F.col("p_brand").alias("label"))
    return graph.find(nodes, name="S", label=brand).select(F.col("id").alias("p_partkey"), "p_name")


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and orders as nodes, with CONTAINS edges."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    name = lambda p, k: F.concat(F.lit(f"{p}:"), F.col(k).cast("string"))
    nodes = r.select(name("r", "r_regionkey").alias("id")).union(n.select(name("n", "n_nationkey"))).union(c.select(name("c", "c_custkey"))).union(o.select(name("o", "o_orderkey")))
    edges = n.select(name("r", "n_regionkey").alias("from_id"), name("n", "n_nationkey").alias("to_id"))
    edges = edges.union(c.select(name("n", "c_nationkey"), name("c", "c_custkey"))).union(o.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    return nodes, edges.withColumns({"rel_type": F.lit("CONTAINS"), "kind": F.lit(None).cast("string")})


TREE = """edges as (select 'r:' || n_regionkey as f, 'n:' || n_nationkey as t from nation union all select 'n:' || c_nationkey, 'c:' || c_custkey from customer union all select 'c:' || o_custkey, 'o:' || o_orderkey from orders)"""


@query(f"""with recursive {TREE}, down(id) as (select 'n:1' union all select e.t from down d join edges e on e.f = d.id) select id from down""")
def descendants(spark, sf_dir):  # K5 D10 C9
    nodes, edges = tree(spark, sf_dir)
    return graph.descendants(nodes, edges, F.col("id") == "n:1")


@query(f"""with recursive {TREE}, both_ways as (select f as a, t as b from edges union all select t, f from edges),
walk(id, d) as (select 'n:1', 0 union all select w.b, d + 1 from walk join both_ways w on w.a = walk.id where d < 2)
select id, min(d)::int as distance from walk group by id order by distance, id limit 200""")
def neighbors_depth_2(spark, sf_dir):  # K2 K3 F6
    nodes, edges = tree(spark, sf_dir)
    return graph.neighbors(nodes, edges, "n:1", depth=2, limit=200)[0]


def relates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as RELATES edges, to parts and to suppliers."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    name = lambda p, k: F.concat(F.lit(f"{p}:"), F.col(k).cast("string"))
    of = lambda to, kind: line.select(name("o", "l_orderkey").alias("from_id"), to.alias("to_id"), F.lit("RELATES").alias("rel_type"), F.lit(kind).alias("kind"), "l_quantity")
    return of(name("p", "l_partkey"), "references").union(of(name("s", "l_suppkey"), "calls"))


RELATES = """rel as (select 'o:' || l_orderkey as from_id, 'p:' || l_partkey as to_id, 'references' as kind, l_quantity from lineitem union all select 'o:' || l_orderkey, 's:' || l_suppkey, 'calls', l_quantity from lineitem)"""


@query(f"""with {RELATES}, one as (select from_id, to_id from rel where kind = 'calls' and from_id = 'o:1'), two as (select from_id from rel where kind = 'calls' and to_id in (select to_id from one))
select id, min(d)::int as distance from (select 'o:1' as id, 0 as d union all select to_id, 1 from one union all select from_id, 2 from two) group by id order by distance, id limit 100""")
def neighbors_kind(spark, sf_dir):  # K2a
    edges = graph.selected(relates(spark, sf_dir), kind="calls")
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select(F.col("to_id").alias("id"))).distinct()
    return graph.neighbors(ids, edges, "o:1", depth=2, limit=100)[0]


@query(f"with {RELATES} select id, count(*) as degree from (select from_id as id from rel union all select to_id from rel) group by id")
def degree(spark, sf_dir):  # D9 G11
    return graph.degree(relates(spark, sf_dir))


@query("""select from_id, to_id, kind, l_quantity from (select *, row_number() over (partition by from_id, to_id, kind order by l_quantity desc) as rn from (
  select 'o:' || l_orderkey as from_id, 'p:' || l_partkey as to_id, 'references' as kind, l_quantity from lineitem union all select 'o:' || l_orderkey, 's:' || l_suppkey, 'calls', l_quantity from lineitem)) where rn = 1""")
def relates_upsert(spark, sf_dir):  # K10 K9 G8
    return graph.merge_edges(relates(spark, sf_dir), [F.desc("l_quantity")]).select("from_id", "to_id", "kind", "l_quantity")


@query("""select c.c_custkey, c.c_name, coalesce(o.n, 0) as links_out, coalesce(l.n, 0) as annotations from customer c left join (select o_custkey, count(*) as n from orders group by 1) o on o.o_custkey = c.c_custkey
left join (select user_id, count(*) as n from events where event_type = 'view' group by 1) l on l.user_id = c.c_custkey""")
def describe_node(spark, sf_dir):  # K1 C6
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_id"), (-F.col("o_orderkey")).alias("to_id"), F.lit("RELATES").alias("rel_type"), F.lit("references").alias("kind"))
    notes = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("target_id"), F.lit("note").alias("kind"), F.col("props").alias("body"), F.col("ts").alias("created_at"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return graph.describe(nodes, edges, notes).select(F.col("id").alias("c_custkey"), "c_name", n("links_out"), n("annotations"))


@query("select doc_id, quality from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and d.doc_id % 7 <> 0) order by quality desc, doc_id limit 50")
def first_orphans(spark, sf_dir):  # F5 K17: the first fifty in an order
    live = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"))
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("target_id"), (-F.col("quality")).alias("created_at"), F.col("doc_id").alias("id"))
    return graph.orphans(notes, live, 50).select(F.col("target_id").alias("doc_id"), (-F.col("created_at")).alias("quality"))


@query("select doc_id from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and d.doc_id % 7 <> 0)")
def orphans(spark, sf_dir):  # C10 K17
    live = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"))
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("target_id"))
    return graph.orphans(notes, live).select(F.col("target_id").alias("doc_id"))


@query("""with live as (select doc_id from documents where doc_id % 7 <> 0)
select l.doc_id as id, case when l.doc_id in (select doc_id from live) then l.doc_id when l.doc_id + 1 in (select doc_id from live) then l.doc_id + 1 else l.doc_id end as target_id from labels l""")
def reattach(spark, sf_dir):  # K18
    live = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"))
    notes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("target_id"))
    return graph.reattach(notes, live, notes.select("id", (F.col("id") + 1).alias("new_target")))


@query("""with e as (select user_id, event_type, event_id from events where user_id % 5 <> 0),
old as (select user_id, max(event_id) as old_id from e where event_type = 'view' and event_id % 2 = 0 group by 1),
new as (select user_id, max(event_id) as new_id from e where event_type = 'view' and event_id % 2 = 1 group by 1)
select event_id as id, user_id as target_id, event_type as kind, event_id as body from e where event_type <> 'view'
union all select coalesce(o.old_id, n.new_id), user_id, 'view', coalesce(n.new_id, o.old_id) from old o full join new n using (user_id)
union all select event_id, user_id, event_type, event_id from events where user_id % 5 = 0 and event_id % 2 = 1""")
def summary_replace(spark, sf_dir):  # K15: odd events are written over what the even ones left, for users that exist; what is for others comes back
    e = table(spark, sf_dir, "events").filter("user_id % 5 <> 0 or event_id % 2 = 1")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("target_id"), F.when(F.col("event_type") == "view", "summary").otherwise(F.col("event_type")).alias("kind"), F.col("event_id").alias("body"), F.col("event_id").alias("created_at"))
    nodes = e.filter("user_id % 5 <> 0").select(F.col("user_id").alias("id")).distinct()
    before, none = graph.annotate(rows.limit(0), rows.filter("id % 2 = 0"), nodes)
    after, lacking = graph.annotate(before, rows.filter("id % 2 = 1"), nodes)
    return after.unionByName(lacking).unionByName(none).select("id", "target_id", F.when(F.col("kind") == "summary", "view").otherwise(F.col("kind")).alias("kind"), "body")


@query("""with old as (select doc_id, source from documents where doc_id % 4 <> 0), new as (select doc_id, source from documents where doc_id % 3 <> 0)
select 'node' as what, doc_id::varchar as a, null as b from new union all select distinct 'node', source, null from documents
union all select 'edge', source, doc_id::varchar from new
union all select 'note', doc_id::varchar, case when doc_id in (select doc_id from old where doc_id not in (select doc_id from new)) then null else doc_id::varchar end from labels
union all select 'member', source, doc_id::varchar from new""")
def ingest_reconcile(spark, sf_dir):  # K12 K13 G3 K24: all documents are parsed anew, each source being one
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    none = F.create_map().cast("map<string,string>")
    name = F.col("doc_id").cast("string")
    members = d.filter("doc_id % 4 <> 0").select(F.col("source").alias("doc_id"), name.alias("id"))
    node = lambda i: (i.alias("id"), F.lit("MarkdownSection").alias("label"), F.lit("kb").alias("kb_name"), none.alias("properties"))
    parents = d.select("source").distinct().select(*node(F.col("source")))
    nodes = d.filter("doc_id % 4 <> 0").select(*node(name)).union(parents)
    contains = lambda rows: rows.select(F.col("source").alias("from_id"), name.alias("to_id"), F.lit("CONTAINS").alias("rel_type"), F.lit(None).cast("string").alias("kind"), none.alias("properties"))
    new = d.filter("doc_id % 3 <> 0")
    notes = table(spark, sf_dir, "labels").select(name.alias("id"), name.alias("target_id"), F.lit(0).alias("updated_at"))
    out = graph.reconcile(nodes, contains(d.filter("doc_id % 4 <> 0")), members, notes, parents, new.select(F.col("source").alias("doc_id"), *node(name)), contains(new), F.lit(1))
    say = lambda part, what, a, b: out[part].select(F.lit(what).alias("what"), F.col(a).alias("a"), b.cast("string").alias("b"))
    parts = say("nodes", "node", "id", F.lit(None)), say("edges", "edge", "from_id", F.col("to_id")), say("annotations", "note", "id", F.col("target_id")), say("members", "member", "doc_id", F.col("id"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""with kb as (select n_nationkey::varchar as name from nation), l as (select c_nationkey::varchar as f, (c_custkey % 30)::varchar as t, case when c_custkey % 2 = 0 then 'depends_on' else 'mirrors' end as kind, c_custkey, c_name from customer),
one as (select f, t, kind, min(c_custkey) as created_at, max_by(c_name, c_custkey) as metadata_json from l where t in (select name from kb) group by 1, 2, 3)
select f as from_kb, t as to_kb, kind, created_at, metadata_json, 'out' as direction from one where f = '3' union all select f, t, kind, created_at, metadata_json, 'in' from one where t = '3'""")
def kb_links(spark, sf_dir):  # K22: links of all customers, of which those of one knowledge base are listed
    kbs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"))
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 2 == 0, "depends_on").otherwise("mirrors").alias("kind")
    rows = c.select(F.col("c_nationkey").cast("string").alias("from_kb"), (F.col("c_custkey") % 30).cast("string").alias("to_kb"), kind, F.col("c_custkey").alias("created_at"), F.col("c_name").alias("metadata_json"))
    links, _ = kb.link_kbs(rows.limit(0), rows, kbs)
    return kb.links_of(links, "3")


@query("""with s as (select doc_id as id from documents), m as (select doc_id as id from labels union select doc_id + 500000 from labels)
select id, 'upsert' as action from s where id not in (select id from m) union all select id, 'delete' from m where id not in (select id from s)""")
def sync_plan(spark, sf_dir):  # K27 G1 G2 C13
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return sync.plan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), ids.union(ids.select(F.col("id") + 500_000)))


@query("""with s as (select doc_id as id from documents), m as (select doc_id as id from labels union select doc_id + 500000 from labels)
select (select count(*) from s) as store_count, (select count(*) from m) as mirror_count, (select count(*) from (select id from s except select id from m)) + (select count(*) from (select id from m except select id from s)) as drift""")
def sync_status(spark, sf_dir):  # D12 D13
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return sync.status(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), ids.union(ids.select(F.col("id") + 500_000)))


@query("""with c as (select 'o:' || l_orderkey as s, 'p:' || l_partkey as t from lineitem) select id, id as label, 'unknown' as kind from (select s as id from c union select t from c)""")
def query_to_graph_shape(spark, sf_dir):  # K25
    r = relates(spark, sf_dir).filter("kind = 'references'")
    none = F.lit(None).cast("string")
    cell = lambda c: r.select(F.col(c).alias("id"), none.alias("label"), none.alias("kind"), none.alias("source"), none.alias("target"))
    return graph.graph_shape(cell("from_id").union(cell("to_id")))[0]


@query(f"""select e.label, e.vec_id, {DISTANCE} as distance, round(1 / (1 + {DISTANCE}), 6) as score {NEAR} qualify row_number() over (partition by e.label order by {DISTANCE}, e.vec_id) <= 5""")
def federated_merged(spark, sf_dir):  # M4 G10 F4
    return search.federated(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), "label", "vec_id", 5, "embedding").select("label", "vec_id", "distance", "score")


@query(f"""select label, string_agg(vec_id::varchar, ',' order by distance, vec_id) as hits from (select e.label, e.vec_id, {DISTANCE} as distance {NEAR} qualify row_number() over (partition by e.label order by {DISTANCE}, e.vec_id) <= 5) group by label""")
def federated_grouped(spark, sf_dir):  # D14
    near = search.federated(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), "label", "vec_id", 5, "embedding")
    hits = F.array_sort(F.collect_list(F.struct("distance", "vec_id")))
    return near.groupBy("label").agg(F.array_join(F.transform(hits, lambda x: x["vec_id"].cast("string")), ",").alias("hits"))


@query("""with shipped as (select doc_id as path, sha256(text) as h from documents where doc_id % 10 <> 1), inst as (select doc_id as path, case when doc_id % 4 = 0 then 'x' else sha256(text) end as h from documents where doc_id % 10 <> 2),
rec as (select doc_id as path, case when doc_id % 8 = 0 then 'x' else sha256(text) end as h from documents where doc_id % 10 <> 3)
select path, case when s.h is null then 'leave' when i.h is null then 'install' when i.h = s.h then 'same' when i.h is not distinct from r.h then 'update' else 'skip' end as action
from shipped s full join inst i using (path) full join rec r using (path)""")
def asset_three_way(spark, sf_dir):  # A32 C18
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    other = lambda n: d.withColumn("hash", F.when(F.col("path") % n == 0, "x").otherwise(F.col("hash")))
    return sync.three_way(d.filter("path % 10 <> 1"), other(4).filter("path % 10 <> 2"), other(8).filter("path % 10 <> 3"))


@query("""with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events),
g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as grp from m) select user_id, min(ts) as began, max(ts) + interval 6 hour as ended, count(*) as changes from g group by user_id, grp""")
def stream_debounce(spark, sf_dir):  # I1 I3
    return watch.bursts(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", gap="6 hours")


@query("""select doc_id::varchar as file_path, doc_id % 10 as chunk_index, case when doc_id % 3 = 0 then upper(source) else source end as content from documents where doc_id % 5 <> 0 or doc_id % 3 = 0""")
def chunk_replace(spark, sf_dir):  # A9 A13 A14 A15: documents are replaced in one snapshot, others are deleted
    d = table(spark, sf_dir, "documents")
    rows = lambda content: d.select(F.col("doc_id").cast("string").alias("file_path"), (F.col("doc_id") % 10).alias("chunk_index"), content.alias("content"), F.col("doc_id").cast("string").alias("chunk_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    root = scratch.folder(spark)
    old = store.write(rows(F.col("source")), root, 0)
    new = rows(F.upper("source")).filter("cast(file_path as bigint) % 3 = 0")
    gone = old.filter("cast(file_path as bigint) % 5 = 0 or cast(file_path as bigint) % 3 = 0").select("file_path")
    store.write(store.replace_documents(old, new, gone, 2), root, 1)
    return store.read(spark, root, "file_path string").select("file_path", "chunk_index", "content")


@query("""select doc_id::varchar as file_path, case when doc_id % 3 = 0 then upper(source) else source end as content, 2::bigint as version from documents where doc_id % 3 = 0 or doc_id % 5 <> 0
union all select doc_id::varchar, 'looked up', 2 from documents where doc_id = 4""")
def bucket_replace(spark, sf_dir):  # A14 A15 A16 A17 A19 A21: documents replaced and deleted in their folders, a stale writer refused, a key looked up
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.coalesce("source", F.lit("")).alias("content"))
    stored = store.Buckets(spark, scratch.folder(spark), "file_path string, content string", "file_path", 16)
    first = stored.replace(d, 0)
    number = F.col("file_path").cast("bigint")
    again = stored.replace(d.filter(number % 3 == 0).withColumn("content", F.upper("content")), first, d.filter((number % 5 == 0) & (number % 3 != 0)))
    try:
        stored.replace(d, first)
    except store.Stale:
        rows = stored.read().unionByName(stored.lookup("4").withColumn("content", F.lit("looked up")))
        return rows.withColumn("version", F.lit(again).cast("bigint"))
    raise ValueError("a writer of an old version went through")


HISTORY = "(select doc_id, 'p' || doc_id as path, sha256(coalesce(source, '')) as h, lang from documents)"


@query(f"""with h as (select path, doc_id, unnest([{{'v': 1, 's': 'new', 'h': h}}, {{'v': 2, 's': case when doc_id % 4 = 0 then 'deleted' else 'changed' end, 'h': case when doc_id % 4 = 0 then null else h || 'x' end}}, {{'v': 3, 's': 'new', 'h': h}}]) as x from {HISTORY}),
k as (select path, x.v as v, x.s as s, x.h as h from h where x.v = 1 or (x.v = 2 and doc_id % 2 = 0) or (x.v = 3 and doc_id % 8 = 0)),
p as (select *, lag(h) over (partition by path order by v) as was from k)
select 'row' as what, path as file_path, v::bigint as version, s as state, was as hash from p
union all select 'as of 2', path, null, null, arg_max(h, v) from k where v <= 2 group by path having arg_max(s, v) <> 'deleted'
union all select '1 to 3', path, null, case when max(v) = 2 and arg_max(s, v) = 'deleted' then 'deleted' else 'changed' end, null from k group by path having arg_max(h, v) is null or arg_max(h, v) <> arg_min(h, v) or (arg_max(s, v) = 'deleted')""")
def manifest_history(spark, sf_dir):  # A10 D11 E9: what files were before, at a version, and between two
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("file_path"), F.sha2(F.coalesce("source", F.lit("")), 256).alias("content_hash"), F.lit(1.0).alias("mtime"), F.lit(1).alias("chunk_count"))
    row = lambda v, state, on, content: d.filter(on).select("file_path", content.alias("content_hash"), "mtime", "chunk_count", F.lit(state).alias("state"), F.lit(v).cast("bigint").alias("version"))
    own, k = F.col("content_hash"), F.col("doc_id")
    past = row(1, "new", F.lit(True), own).unionByName(row(2, "deleted", k % 4 == 0, F.lit(None).cast("string"))).unionByName(row(2, "changed", (k % 2 == 0) & (k % 4 != 0), F.concat(own, F.lit("x")))).unionByName(row(3, "new", k % 8 == 0, own))
    past = scratch.written(past)
    none = lambda kind: F.lit(None).cast(kind)
    return (
        incremental.previous(past).select(F.lit("row").alias("what"), "file_path", "version", "state", F.col("previous_hash").alias("hash"))
        .unionByName(incremental.as_of(past, 2).select(F.lit("as of 2").alias("what"), "file_path", none("bigint").alias("version"), none("string").alias("state"), F.col("content_hash").alias("hash")))
        .unionByName(incremental.changed_between(past, 1, 3).select(F.lit("1 to 3").alias("what"), "file_path", none("bigint").alias("version"), "state", none("string").alias("hash")))
    )


@query("""select query_id, vec_id, distance, place from (select q.vec_id as query_id, c.vec_id as vec_id, d as distance, row_number() over (partition by q.vec_id order by d, c.vec_id)::int as place
from embeddings q, embeddings c, lateral (select round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))), 6) as d) t) where place <= 5""")
def nearest_of_all(spark, sf_dir):  # C17: the nearest of all vectors for each of them
    e = table(spark, sf_dir, "embeddings")
    return search.top_k_each(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), e.select("vec_id", F.col("embedding").alias("vector")), "vec_id", 5)


@query("""select event_id, (props->>'$.k')::int as k, event_type as tag, case when event_id % 3 = 0 then true end as deep from events where event_id % 10 <> 0 and (props->>'$.k')::int > 50
union all select -1, null, 'OBJECT<a: OBJECT<more: OBJECT<deep: BOOLEAN>, props: OBJECT<k: BIGINT>>, tags: ARRAY<STRING>>', null""")
def nested_props(spark, sf_dir):  # H12 A8: nested properties survive as they are, are filtered on by path, and what is no JSON is null
    e = table(spark, sf_dir, "events")
    more = F.when(F.col("event_id") % 3 == 0, '{"deep": true}').otherwise("{}")
    text = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"a": {"props": '), "props", F.lit(', "more": '), more, F.lit('}, "tags": ["x", "'), "event_type", F.lit('"]}')))
    held = e.select("event_id", variants.parsed(text).alias("v"))
    found = held.select("event_id", variants.field(F.col("v"), "$.a.props.k", "int").alias("k"), variants.field(F.col("v"), "$.tags[1]").alias("tag"), variants.field(F.col("v"), "$.a.more.deep", "boolean").alias("deep")).filter("k > 50")
    return found.union(spark.createDataFrame([(-1, None, variants.shape(held, "v"), None)], found.schema))


@query("""select o_orderkey as id, '{"_type":"node","id":"o' || o_orderkey || '","labels":["A","Order"],"properties":{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","raw":"' || lower(hex(encode(o_orderpriority))) || '","list":["' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z",null],"map":{"' || o_custkey || '":' || case when o_orderkey % 2 = 0 then 'null' else o_custkey::varchar end || '}}}' as cell from orders
union all select -o_orderkey, '{"_type":"path","nodes":["o' || o_orderkey || '","c' || o_custkey || '"],"relationships":[{"_type":"relationship","id":"r","type":"by","start":"o' || o_orderkey || '","end":null,"properties":null}]}' from orders
union all select 0, 'null'""")
def coerced_values(spark, sf_dir):  # H33: nodes, relationships and paths as JSON, with days, times, bytes and maps at any depth
    o = table(spark, sf_dir, "orders")
    name, at = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderdate").cast("timestamp")
    held = F.struct(F.col("o_orderdate").cast("date").alias("day"), F.encode("o_orderpriority", "UTF-8").alias("raw"), F.array(at, F.lit(None).cast("timestamp")).alias("list"), F.create_map("o_custkey", F.when(F.col("o_orderkey") % 2 != 0, F.col("o_custkey"))).alias("map"))
    nodes = variants.as_json(o.select(F.col("o_orderkey").alias("id"), variants.node_value(name, F.array(F.lit("Order"), F.lit("A")), held).alias("cell")), "cell")
    none = F.lit(None).cast("string")
    way = variants.path_value(F.array(name, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), F.array(variants.relationship_value(F.lit("r"), F.lit("by"), name, none, none)))
    paths = variants.as_json(o.select((-F.col("o_orderkey")).alias("id"), way.alias("cell")), "cell")
    empty = variants.as_json(o.select(F.lit(0).cast("bigint").alias("id"), F.lit(None).cast("binary").alias("cell")).limit(1), "cell")
    return nodes.unionByName(paths).unionByName(empty)


@query("select count(*) as chunks, true as close from lineitem")
def status_sketches(spark, sf_dir):  # D2 D13: distinct documents from sketches of parts, within 5 % of what counting says
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_path"))
    found = incremental.from_sketches(incremental.sketched(rows, F.pmod(F.xxhash64("file_path"), F.lit(8)), "file_path"))
    exact = rows.agg(F.count_distinct("file_path").alias("exact"))
    return found.crossJoin(F.broadcast(exact)).select(F.col("n").alias("chunks"), (F.abs(F.col("keys") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query("select doc_id, 'text' as kind, '' as language, '' as artifact_qualname, '' as parent_document_id, source as header_breadcrumb, source as section_breadcrumb from documents")
def schema_evolution(spark, sf_dir):  # A11 A12
    return store.evolved_chunks(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("header_breadcrumb")))


@query("""select doc_id::varchar as file_path, case when doc_id % 2 = 0 then sha256(text) else 'old' end as content_hash, case when doc_id % 2 = 0 then 2.0 when doc_id % 3 = 0 then 5.0 else 1.0 end::double as mtime from documents where doc_id % 7 <> 0""")
def manifest_upsert(spark, sf_dir):  # A16 A17 A18 A19
    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("path"), "text")
    old = d.select("path", F.lit("old").alias("content_hash"), F.lit(1.0).alias("mtime"))
    fresh = d.filter("doc_id % 2 = 0").select("path", F.sha2("text", 256).alias("content_hash"), F.lit(2.0).alias("mtime"))
    touched = incremental.touch_mtime(old, d.filter("doc_id % 3 = 0").select("path", F.lit(5.0).alias("mtime")))
    kept = store.delete(incremental.upsert(touched, fresh, ["path"]), d.filter("doc_id % 7 = 0"), ["path"])
    return kept.select(F.col("path").alias("file_path"), "content_hash", "mtime")


@query("""select n_name as name, n_regionkey as created_at, 9 as updated_at, case when n_regionkey = 1 then 'new' else 'old' end as project_root from nation where n_name like 'NATION_1%' and n_regionkey <> 4""")
def kb_list(spark, sf_dir):  # K21 K33 B12
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_name").alias("name"), F.lit("old").alias("project_root"), F.array(F.col("n_regionkey").cast("string")).alias("tags"), F.lit("{}").alias("metadata_json"), F.col("n_regionkey").alias("created_at"), F.lit(9).alias("updated_at"))
    links = rows.select(F.col("name").alias("from_kb"), F.col("name").alias("to_kb"))
    changed = kb.upsert_kbs(rows, rows.filter("created_at = 1").select("name", F.lit("new").alias("project_root"), "tags", "metadata_json"), F.lit(9))
    kept, _ = kb.delete_kbs(changed, links, rows.filter("created_at = 4").select("name"))
    return kb.list_kbs(kept, "NATION_1").select("name", "created_at", "updated_at", "project_root")


@query("""select n_nationkey as name, coalesce(s.n, 0) as links_out, coalesce(c.n, 0) as links_in from nation left join (select s_nationkey, count(*) as n from supplier group by 1) s on s_nationkey = n_nationkey
left join (select s_suppkey % 30 as k, count(*) as n from supplier group by 1) c on c.k = n_nationkey""")
def kb_link_counts(spark, sf_dir):  # C12
    links = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("from_kb"), (F.col("s_suppkey") % 30).alias("to_kb"))
    return kb.link_counts(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name")), links)


@query("""with l as (select 'o:' || l_orderkey as from_id, 'p:' || l_partkey as to_id, l_linenumber, l_suppkey from lineitem where l_orderkey % 3 <> 0),
one as (select from_id, to_id, max_by(l_suppkey, l_linenumber) as author from l group by 1, 2)
select from_id, to_id, 'documents' as kind, 'user:' || author as author from one""")
def relates_link(spark, sf_dir):  # C7 C8 K11 K23: links of orders that exist, batch by batch, the others refused
    line = table(spark, sf_dir, "lineitem")
    numbered = F.col("l_linenumber").isNotNull()  # a line without a number names no author
    rows = line.select(F.concat(F.lit("o:"), "l_orderkey").alias("from_id"), F.concat(F.lit("p:"), "l_partkey").alias("to_id"), F.lit("documents").alias("kind"), F.when(numbered, F.concat(F.lit("user:"), "l_suppkey")).alias("author"), F.lit("{}").alias("metadata_json"), "l_linenumber", *stored_at(line))
    # of lines with one number the first in storage counts
    rows = incremental.latest(rows, ["from_id", "to_id"], [F.col("author").isNull(), F.desc("l_linenumber"), "file_path", "row_index"]).drop("l_linenumber", "file_path", "row_index")
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"))
    nodes = orders.union(table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey")))
    edges, _ = kb.link_artifacts(spark.createDataFrame([], EDGES), rows, nodes)
    return edges.select("from_id", "to_id", "kind", F.col("properties")["author"].alias("author"))


@query("""select o_custkey % 3 = 0 as orphaned, count(*) as annotations from orders group by 1""")
def annotation_targets(spark, sf_dir):  # C11 K16 K19: annotations with their targets, which may be gone
    nodes = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.lit("Class").alias("label"), F.create_map(F.lit("name"), F.col("c_name")).alias("properties"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target_id"))
    return kb.with_targets(notes, nodes).groupBy(F.col("target_label").isNull().alias("orphaned")).agg(F.count("*").alias("annotations"))


@query("""with e as (select r_regionkey, 'r:' || r_regionkey as f, 'n:' || n_nationkey as t from region join nation on n_regionkey = r_regionkey union all select null, 'n:' || n_nationkey, 's:' || s_suppkey from nation join supplier on s_nationkey = n_nationkey)
select f as from_id, t as to_id from e where f = 'r:1' or f in (select t from e where f = 'r:1')""")
def neighbors_edges(spark, sf_dir):  # K2: the edges walked
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda p, k: F.concat(F.lit(f"{p}:"), F.col(k).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("from_id"), name("n", "n_nationkey").alias("to_id")).union(s.select(name("n", "s_nationkey"), name("s", "s_suppkey")))
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    return graph.neighbors(ids, edges, "r:1", 2, 1_000_000, "out")[1]


@query("""select count(*) as files_total, count(*) filter (doc_id % 4 in (0, 1)) as files_processed, count(*) filter (doc_id % 4 in (2, 3)) as files_skipped, 0 as files_deleted,
  (sum(doc_id % 5) filter (doc_id % 4 < 2))::bigint as chunks_created, (sum(doc_id % 3) filter (doc_id % 4 < 2))::bigint as cache_hits, (sum(doc_id % 2) filter (doc_id % 4 < 2))::bigint as cache_misses from documents""")
def job_counters(spark, sf_dir):  # D7 B24
    d, did = table(spark, sf_dir, "documents"), F.col("doc_id") % 4 < 2
    state = F.element_at(F.array(*map(F.lit, ("new", "changed", "same_time", "same_content"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = d.select(state.alias("state"), *[F.when(did, F.col("doc_id") % k).alias(c) for c, k in (("chunks", 5), ("hits", 3), ("misses", 2))])
    return incremental.job_counters(rows).drop("cache_hit_rate")


@query(f"""with near as (select e.label, e.vec_id, {DISTANCE} as distance {NEAR} qualify row_number() over (partition by e.label order by {DISTANCE}, e.vec_id) <= 3)
select p.label, p.label % 2 = 1 as unreachable, case when p.label % 2 = 0 then count(n.vec_id) else -1 end as hits from (select distinct label from embeddings) p left join near n on n.label = p.label group by p.label""")
def federated_by_peer(spark, sf_dir):  # D14 M4 A28: peers that are down are listed without hits
    e = table(spark, sf_dir, "embeddings")
    hits = search.federated(e, first_vector(spark, sf_dir), "label", "vec_id", 3, "embedding")
    peers = e.select("label").distinct().withColumn("status", F.when(F.col("label") % 2 == 0, "alive").otherwise("unreachable"))
    return search.by_peer(hits, peers, "label", "vec_id").select("label", "unreachable", F.coalesce(F.nullif(F.size("hits"), F.lit(-1)), F.lit(-1)).cast("long").alias("hits"))


@query("""select id from (select doc_id as id from documents) order by id""")
def sync_applied(spark, sf_dir):  # K27 A31 I7: the mirror after its plan
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return sync.applied(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), ids.union(ids.select(F.col("id") + 500_000)).distinct())


def named(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


@query("""select name, direction from (select 'n:' || s_nationkey as f, 's:' || s_suppkey as name, 'out' as direction from supplier union all select 'n:' || s_suppkey % 30, 's:' || s_suppkey, 'in' from supplier) where f = 'n:7'""")
def kb_links_by_direction(spark, sf_dir):  # K20 K22: out of a name, into it, both
    s = table(spark, sf_dir, "supplier")
    links = s.select(named("n", "s_nationkey").alias("from_kb"), named("s", "s_suppkey").alias("to_kb")).union(s.select(named("s", "s_suppkey"), F.concat(F.lit("n:"), (F.col("s_suppkey") % 30).cast("string"))))
    both = kb.links_of(links, "n:7")
    return both.select(F.when(F.col("direction") == "out", F.col("to_kb")).otherwise(F.col("from_kb")).alias("name"), "direction")


@query("""select n_regionkey as deleted_region, count(*) as deleted from nation join supplier on s_nationkey = n_nationkey where n_regionkey = 2 group by 1""")
def unlinked_count(spark, sf_dir):  # D11: how many rows a deletion takes
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    gone = n.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("from_kb"))
    return kb.deleted(s.select(F.col("s_nationkey").alias("from_kb"), "s_suppkey"), gone, ["from_kb"]).select(F.lit(2).alias("deleted_region"), "deleted")


@query("""select o_orderkey as id, case when o_orderkey % 3 = 0 then 'clerk' when o_orderkey % 3 = 1 then 'agent:' || o_orderpriority else 'user:unknown' end as author from orders""")
def annotation_author(spark, sf_dir):  # B18: as said, else the client, else unknown; blanks say nothing
    o, turn = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    said, client = F.when(turn == 0, " clerk ").when(turn == 1, "  "), F.when(turn == 2, "").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), kb.author(said, client).alias("author"))


@query("""select 'c:' || c_custkey as target_id, to_json({'target_id': 'c:' || c_custkey, 'target_kind': 'Class', 'breadcrumb': case when c_custkey % 2 = 0 then c_mktsegment else c_name end})::varchar as target_snapshot from customer""")
def target_snapshots(spark, sf_dir):  # H30: the first of breadcrumb, qualified name and name
    also = F.map_filter(F.create_map(F.lit("name"), F.col("c_name"), F.lit("qualname"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))), lambda k, v: v.isNotNull())
    return kb.target_snapshot(table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("id"), F.lit("Class").alias("label"), also.alias("properties")))


@query("""select 'federation' as id, 'federation' as label, 'federation' as kind, null as parent union all select n_name, n_name, 'kb', 'federation' from nation where n_name = 'NATION_3'""")
def federation_roots(spark, sf_dir):  # K26: the federation and the local knowledge base
    return kb.roots(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "NATION_3")


@query("""select 'n:' || s_nationkey as source, 's:' || s_suppkey as target, case when s_suppkey % 2 = 0 then 'calls' else 'contains' end as kind from supplier""")
def edges_for_views(spark, sf_dir):  # K29: the kind, else the type
    s = table(spark, sf_dir, "supplier")
    return kb.web_edges(s.select(named("n", "s_nationkey").alias("from_id"), named("s", "s_suppkey").alias("to_id"), F.lit("CONTAINS").alias("rel_type"), F.when(F.col("s_suppkey") % 2 == 0, "calls").alias("kind")))


@query("""select doc_id, case when doc_id % 3 = 0 then source || '!' when doc_id % 3 = 1 then 'd' || doc_id || '.md' else 'docs/' end as title, substr(text, 1, 200) as excerpt,
  case when doc_id % 3 = 0 then [source, 'x'] when doc_id % 3 = 1 then ['a', 'b'] else ['label'] end as tags from documents""")
def titles_and_excerpts(spark, sf_dir):  # B19 B20 M2: titles and tags of headers, else of paths and labels
    d, turn = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    header = F.when(turn == 0, F.to_json(F.struct(F.concat("source", F.lit("!")).alias("title"), F.array("source", F.lit("x")).alias("tags")))).when(turn == 1, F.lit('{"title": "", "tags": "a, b"}')).otherwise("no JSON")
    path = F.when(turn == 2, "docs/").otherwise(F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select("doc_id", tx.title(header, path).alias("title"), search.excerpt(F.col("text"), 200).alias("excerpt"), tx.tags(header, F.array(F.lit("label"))).alias("tags"))


@query("""select event_id, case when event_id % 3 = 0 then props::json->>'$.k' end as k, case when event_id % 3 = 1 then 2 else 0 end as listed from events""")
def safe_json(spark, sf_dir):  # H12: what is no JSON of the shape is empty
    e, turn = table(spark, sf_dir, "events"), F.col("event_id") % 3
    text = F.when(turn == 0, F.col("props")).when(turn == 1, F.lit('["a", "b"]')).otherwise("[oops")
    return e.select("event_id", tx.json_map(F.when(turn != 1, text))["k"].alias("k"), F.size(tx.json_list(F.when(turn != 0, text))).alias("listed"))


@query("""select p_partkey, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') as name_is, regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z_][A-Za-z0-9_]*') as joined_is, false as digit_is from part""")
def identifiers(spark, sf_dir):  # H32
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.is_identifier(F.col("p_name")).alias("name_is"), tx.is_identifier(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("joined_is"), tx.is_identifier(F.concat(F.lit("1"), "p_brand")).alias("digit_is")
    )


@query("""select event_id, case when event_id % 5 < 4 then event_id % 5 end::int as major, case when event_id % 5 < 4 then user_id end::int as minor, event_id % 5 = 1 as compatible from events""")
def versions(spark, sf_dir):  # H34: the same major number; what is no version is not compatible
    major = (F.col("event_id") % 5).cast("string")
    text = F.when(F.col("event_id") % 5 < 4, F.concat_ws(".", major, F.col("user_id").cast("string"), F.lit("7-beta"))).otherwise("latest")
    read = tx.version(text)
    return table(spark, sf_dir, "events").select("event_id", read["major"].alias("major"), read["minor"].alias("minor"), tx.compatible(F.lit("1.4.0"), text).alias("compatible"))


@query("""select event_id, event_id * 1000 + 7 as milliseconds, strftime(make_timestamp(event_id * 1000000), '%M:%S') as clock from events""")
def utc_times(spark, sf_dir):  # H31
    at = tx.utc(F.col("event_id") * 1000 + 7)
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(at).alias("milliseconds"), F.date_format(at, "mm:ss").alias("clock"))


@query("""select c_name as name, case when c_custkey in (select o_custkey from orders) then 'alive' else 'unreachable' end as status from customer where c_name <> 'Customer#000000005'""")
def peer_status(spark, sf_dir):  # A28
    from lorestone.sources import files

    peers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("pid")).filter("name <> 'Customer#000000005'")
    return files.peer_status(peers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pid")).distinct()).select("name", "status")


@query(f"""with near as (select e.vec_id, {DISTANCE} as distance {NEAR} order by 2, 1 limit 50)
select vec_id, 'Class' as node_label, quality as node_quality from near join labels on doc_id = vec_id where toxic = 0""")
def hybrid_pivot(spark, sf_dir):  # C15: hits with the graph nodes that they are about
    hits = search.top_k(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), "vec_id", 50, "embedding").withColumn("artifact_qualname", named("a", "vec_id"))
    about = F.create_map(F.lit("quality"), F.col("quality").cast("string"))
    nodes = table(spark, sf_dir, "labels").filter("toxic = 0").select(named("a", "doc_id").alias("id"), F.lit("Class").alias("label"), about.alias("properties"))
    return search.pivot_to_nodes(hits, nodes).select("vec_id", "node_label", F.col("node_properties")["quality"].cast("int").alias("node_quality"))


@query("""with j as (select o_orderkey as id, o_orderstatus as s, o_orderdate as t, o_custkey % 7 as h, o_custkey % 5 as m from orders)
select (select count(distinct source) from documents) as documents, (select count(*) from documents) as chunks, (select id from j where s = 'O' order by t desc, id desc limit 1) as current_job,
  (select count(*) from labels) as cache_entries, (select h::double / nullif(h + m, 0) from j where s = 'F' order by t desc, id desc limit 1) as last_hit_rate""")
def status_rollup(spark, sf_dir):  # D8 D13 M6 M8
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), state.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("finished_at"), (F.col("o_custkey") % 7).alias("cache_hits"), (F.col("o_custkey") % 5).alias("cache_misses")
    )
    return incremental.status(table(spark, sf_dir, "documents").select(F.col("source").alias("file_path")), jobs, table(spark, sf_dir, "labels"))


@query("""select doc_id, case when doc_id % 2 = 0 then 5 when doc_id % 3 = 0 then 9 else 1 end as accessed_at, case when doc_id % 2 = 0 then 5 else 1 end as created_at, case when doc_id % 2 = 0 then 2 else 4 end as dimensions
from documents where doc_id % 10 <> 7 or doc_id % 3 = 0""")
def cache_changes(spark, sf_dir):  # A20 A21 A22: rows are put, touched and pruned
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("content_hash"), F.lit("m").alias("model"), "doc_id")
    old = d.select("content_hash", "model", F.lit(4).alias("dimensions"), F.lit("v").alias("vector"), F.lit(1).alias("created_at"), F.when(F.col("doc_id") % 10 == 7, 0).otherwise(1).alias("accessed_at"))
    touched = incremental.cache_touch(old, d.select("content_hash", (F.col("doc_id") % 3 == 0).alias("hit")), F.lit(9))
    put = d.filter("doc_id % 2 = 0").select("content_hash", "model", F.lit(2).alias("dimensions"), F.lit("w").alias("vector"))
    kept = incremental.cache_prune(incremental.cache_put(touched, put.union(put), F.lit(5)), 9, F.lit(10))
    return kept.select(F.col("content_hash").cast("long").alias("doc_id"), "accessed_at", "created_at", "dimensions")


@query("""select c_custkey, c_name as name, case when c_custkey % 3 = 0 then 'new' else c_mktsegment end as segment, case when c_custkey % 3 = 0 then 'yes' end as added, case when c_custkey % 3 = 0 then 'kb2' else 'kb1' end as kb_name from customer
union all select c_custkey + 1000000, null, 'new', 'yes', 'kb2' from customer where c_custkey % 30 = 0""")
def nodes_upsert(spark, sf_dir):  # K8: new properties over old ones, old keys stay
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.col("c_custkey").alias("id"), F.lit("Class").alias("label"), F.lit("kb1").alias("kb_name"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("properties"))
    fresh = F.create_map(F.lit("segment"), F.lit("new"), F.lit("added"), F.lit("yes"))
    ids = c.filter("c_custkey % 3 = 0").select("c_custkey").union(c.filter("c_custkey % 30 = 0").select(F.col("c_custkey") + 1_000_000))
    changed = graph.upsert_nodes(nodes, ids.select(F.col("c_custkey").alias("id"), F.lit("Class").alias("label"), F.lit("kb2").alias("kb_name"), fresh.alias("properties")))
    return changed.select(F.col("id").alias("c_custkey"), *[F.col("properties")[k].alias(k) for k in ("name", "segment", "added")], "kb_name")


@query("""with n as (select 'r:' || r_regionkey as id, r_regionkey as r from region union all select 'n:' || n_nationkey, n_regionkey from nation union all select 's:' || s_suppkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey)
select id, case when r <> 1 then id end as target_id, r = 1 as gone from n""")
def document_deleted(spark, sf_dir):  # K5 K6 K13 K14: a document goes with all below it, annotations stay as orphans
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    regions = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("id"))
    nodes = regions.union(n.select(named("n", "n_nationkey"))).union(s.select(named("s", "s_suppkey")))
    below = n.select(named("r", "n_regionkey").alias("from_id"), named("n", "n_nationkey").alias("to_id"))
    edges = below.union(s.select(named("n", "s_nationkey"), named("s", "s_suppkey"))).select("*", F.lit("CONTAINS").alias("rel_type"))
    notes = nodes.select("id", F.col("id").alias("target_id"), F.lit(0).alias("updated_at"))
    left = graph.delete_document(nodes, edges, below.select(F.col("from_id").alias("doc_id"), F.col("to_id").alias("id")), notes, regions.filter("id = 'r:1'"), F.lit(1))
    here = left["nodes"].select("id", F.lit(False).alias("gone"))
    return left["annotations"].join(here, "id", "left").select("id", "target_id", F.coalesce("gone", F.lit(True)).alias("gone"))


@query("""select case when doc_id % 7 < 5 then 'src/p' else 'lib/p' end || doc_id % 7 || '/in/m' || doc_id || '.py' as path, case when doc_id % 7 < 5 then 'p' || doc_id % 7 || '.in.m' || doc_id else 'm' || doc_id end as module from documents""")
def module_names(spark, sf_dir):  # A34 H18: dotted names below the folder that holds the topmost package, for namespaces (p4) too, file names elsewhere
    from lorestone.sources import parsers

    d = table(spark, sf_dir, "documents")
    folder = F.concat(F.when(F.col("doc_id") % 7 < 5, "src/p").otherwise("lib/p"), (F.col("doc_id") % 7).cast("string"))
    files = d.select(F.concat(folder, F.lit("/in/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))
    inits = d.filter("doc_id % 7 < 4").select(folder.alias("f")).distinct()
    inits = inits.select(F.concat("f", F.lit("/__init__.py")).alias("path")).union(inits.select(F.concat("f", F.lit("/in/__init__.py"))))
    return parsers.with_modules(files, parsers.package_roots(files.union(inits)))


@query("""with r as (select doc_id, row_number() over (partition by source order by doc_id) as place from documents) select doc_id from r where place = 1""")
def nodes_one_each(spark, sf_dir):  # K12: one row of each key, the same on every run
    return graph.one_each(table(spark, sf_dir, "documents").select("source", F.format_string("%012d", "doc_id").alias("id")), ["source"]).select(F.col("id").cast("long").alias("doc_id"))
