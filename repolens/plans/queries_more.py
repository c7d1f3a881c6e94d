"""Further registered queries: file formats round trips (S2, S6, S10, S14),
repository list and tag dimension (S12, S13), PR intake and description
update (U2, U4), classification, function annotation and embeddings
(L5, L7, R4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..operators import annotate as L
from ..operators import code_metrics as M
from ..operators import load as U
from ..operators import pulls as P
from ..operators import retrieve as R
from ..operators import tags as G
from ..session import scratch_path
from ..sources import commit_log as S1
from ..sources import fixtures as X
from ..sources import logs as LG
from ..sources import source_files as SF
from .queries_code import scored_sql
from .queries_retrieval import extract_sql
from .registry import query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
PR = X.sql_with(X.SQL_PULL_REQUESTS)
PL = X.sql_with(X.SQL_CHANGES_LONG, X.SQL_PULL_REQUESTS)


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


@query("changes_csv_roundtrip", LONG + """select repo_owner, repo_name, commit_hash, committed_at,
  author, filename, churn_count, description from changes_long""")
def q_changes_csv_roundtrip(spark, sf):
    # Quoted CSV with header and the fixed schema (no inference)
    path = _tmp(spark, "changes-csv")
    S1.write_changes(X.changes_long(spark, sf), path, fmt="csv")
    back = S1.read_changes(spark, path, fmt="csv")
    return back.select(*REPO, "commit_hash", "committed_at", "author", "filename", "churn_count",
                       "description")


@query("cost_log_roundtrip", """select cast(sum(cast(ceil(length(text) / 4.0) as bigint)) * 0.000000150
  as decimal(30,10)) as cost_to_date from conversations where role <> 'assistant'""")
def q_cost_log_roundtrip(spark, sf):
    # One cost-log line per user/system message (input tokens at the
    # default input price), appended under a '#' header, read back and summed
    from .queries_sources import PRICES, DEFAULT_SERVICE, DEFAULT_MODEL
    price = PRICES[DEFAULT_SERVICE][DEFAULT_MODEL]["input"]
    path = _tmp(spark, "costlog")
    spark.createDataFrame([("#date\tmodel\tinput\toutput\tcost",)], "value string").write.text(path)
    m = X.read_table(spark, sf, "conversations").filter(F.col("role") != "assistant")
    tok = L.estimate_tokens("text")
    rows = m.select(F.lit("2024-01-01").alias("date"),
                    F.lit(f"{DEFAULT_SERVICE}-{DEFAULT_MODEL}").alias("model"),
                    tok.alias("input"), F.lit(0).cast("bigint").alias("output"),
                    (tok.cast("decimal(20,0)") * F.lit(price).cast("decimal(12,6)")
                     / 1000000).cast("decimal(30,12)").alias("cost"))
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")) \
        .write.mode("append").text(path)
    return LG.cost_to_date(LG.read_cost_log(spark, path)).select(
        F.col("cost_to_date").cast("decimal(30,10)").alias("cost_to_date"))


@query("list_repos", LONG + "select distinct repo_owner, repo_name from changes_long")
def q_list_repos(spark, sf):
    return LG.list_repos(X.changes_long(spark, sf))


def _tags_sql() -> str:
    names = [n.strip() for n in G.DEFAULT_TAGS.split(",")]
    vals = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(names))
    return (PR + f""", t(tag_id, name) as (values {vals})
select r.repo_owner, r.repo_name, cast(t.tag_id as integer) as tag_id, t.name
from (select distinct repo_owner, repo_name from pulls) r, t""")


@query("tags_dim", _tags_sql())
def q_tags_dim(spark, sf):
    # The default tag list for every repository of the PR table
    return G.tags_dim(G.DEFAULT_TAGS, X.pull_requests(spark, sf))


@query("insert_new_pulls", PR + """select repo_owner, repo_name, number, title, state, created_at
from pulls where created_at >= timestamp '1998-01-01'""")
def q_insert_new_pulls(spark, sf):
    # Only PR numbers not yet stored are appended
    prs = X.pull_requests(spark, sf)
    target = prs.filter(F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    new = U.insert_new(target, prs, [*REPO, "number"], ["created_at"])
    return new.select(*REPO, "number", "title", "state", "created_at")


@query("pr_descriptions", PL + """, und as (
  select distinct repo_owner, repo_name, merge_commit_sha, number from pulls where description is null),
d as (select repo_owner, repo_name, commit_hash, filename, description
      from changes_long where description is not null),
t as (
  select u.repo_owner, u.repo_name, u.number,
    coalesce(string_agg(d.description, chr(10) || '--' || chr(10) order by d.filename), '') as text
  from und u left join d on u.repo_owner = d.repo_owner and u.repo_name = d.repo_name
    and u.merge_commit_sha = d.commit_hash group by 1, 2, 3)
select p.repo_owner, p.repo_name, p.number, coalesce(t.text, p.description) as description
from pulls p left join t on p.repo_owner = t.repo_owner and p.repo_name = t.repo_name and p.number = t.number""")
def q_pr_descriptions(spark, sf):
    # U4: set each undescribed PR's description by number (here to its
    # change text, A17, in place of a model summary)
    prs = X.pull_requests(spark, sf)
    text = P.pr_text(prs, X.changes_long(spark, sf)).withColumnRenamed("text", "description")
    out = U.update_by_key(prs, text, [*REPO, "number"], ["description"])
    return out.select(*REPO, "number", "description")


_CLASSES = ["Small", "Large", "Medium", "Brass", "Steel", "Copper"]


@query("classify_changes", LONG + f""", d as (
  select repo_owner, repo_name, commit_hash, filename, lower(concat(filename, ' ', description)) as t
  from changes_long where trim(coalesce(description, '')) <> ''),
w as (
  select d.*, g.tag_id, cast((length(t) - length(replace(t, g.name, ''))) // length(g.name) as bigint) as n
  from d, (values {', '.join(f"({i}, '{n.lower()}')" for i, n in enumerate(_CLASSES, 1))}) as g(tag_id, name))
select repo_owner, repo_name, commit_hash, filename, cast(tag_id as int) as tag_id,
  cast(n as double) / cast(sum(n) over (partition by repo_owner, repo_name, commit_hash, filename) as double) as value
from w where n > 0""")
def q_classify_changes(spark, sf):
    """L5 -> G1 -> G2 -> G3: described code changes classified by the
    offline keyword tagger, parsed, normalised and written as tag rows."""
    ch = X.changes_long(spark, sf)
    tags = G.tags_dim("Small, Large, Medium, Brass, Steel, Copper", ch)
    todo = G.untagged(ch, spark.createDataFrame(
        [], "repo_owner string, repo_name string, commit_hash string, filename string"),
        ["commit_hash", "filename"])
    p = L.render(L.TEMPLATES["classify_description"], tags=F.lit("Small, Large, Medium, Brass, Steel, Copper"),
                 description=F.concat_ws(" ", "filename", "description"))
    ans = L.annotate(todo, p, L.KeywordTagger(["Small", "Large", "Medium", "Brass", "Steel", "Copper"]),
                     _tmp(spark, "cache"), out="response")
    key = ["commit_hash", "filename"]
    shares = G.normalise(G.parse_tags(ans, tags, key), key)
    return G.commit_tags(shares, tags, key)


_RATE = "concat('Rate readability 0-1.', chr(10), 'Filename: ', file_path, chr(10), 'Function: ', name, chr(10), code)"


@query("rate_functions", scored_sql(f"cast(concat('0.', length({_RATE}) % 10) as double)") + f"""
select repo_owner, repo_name, file_path, name,
  {extract_sql("concat('Filename: ', file_path, chr(10), 'Function: ', name, chr(10), code)", 12)} as description,
  llm_code_readability, composite_complexity from scored""")
def q_rate_functions(spark, sf):
    """L7/M12 -> M11: parsed functions described and rated through the
    cache (offline completers), the rating parsed as readability."""
    path = _tmp(spark, "functions")
    M.extract_functions(X.part_source_files(spark, sf)).write.parquet(path)
    fns = spark.read.parquet(path).filter(F.col("type") == "function")
    cache = _tmp(spark, "cache")
    desc = L.annotate(fns, L.render(L.TEMPLATES["describe_code"], filename="file_path",
                                    func_name="name", code="code"),
                      L.ExtractiveCompleter(12), cache, out="description")
    rated = L.annotate(desc, L.render(L.TEMPLATES["rate_code"], filename="file_path",
                                      func_name="name", code="code"),
                       lambda ps: [f"0.{len(p) % 10}" for p in ps], cache, out="_score")
    scored = M.composite_complexity(rated.withColumn("llm_code_readability", M.readability("_score")))
    return scored.select(*REPO, "file_path", "name", "description", "llm_code_readability",
                         "composite_complexity")


@query("repo_map_roundtrip", f"""with p as (
  select concat('mfgr', substr(p_brand, 7, 1)) as repo_name, concat('src/', replace(lower(p_brand), '#', '_'), '/mod_',
    cast(p_partkey // {X.FUNCTIONS_PER_FILE} as varchar), '.py') as file_path, case when p_partkey % 2 = 0 then 9 else 6 end as n from part)
select 'tpch' as repo_owner, repo_name, file_path, count(*) as definitions, cast(sum(n) as bigint) as lines from p group by 2, 3""")
def q_repo_map_roundtrip(spark, sf):
    """Parsed definitions and top-level code written as one JSON
    document per file, read back flat."""
    files = X.part_source_files(spark, sf)
    path = _tmp(spark, "repomap")
    SF.write_repo_map(M.extract_functions(files), M.extract_top_level(files), path)
    fns, top = SF.read_repo_map(spark, path)
    return fns.groupBy(*REPO, "file_path").agg(F.count(F.lit(1)).alias("definitions"),
                                              F.sum("lines_of_code").alias("lines"))


@query("embed_nearest_chunks")
def q_embed_nearest_chunks(spark, sf):
    """R1 -> S14 -> R4 -> R5: document chunks indexed (written per index and
    read back), embedded by the offline embedder; each benchmark passage's
    five nearest chunks."""
    docs = X.read_table(spark, sf, "documents")
    path = _tmp(spark, "index")
    SF.write_index(R.chunk(docs, "doc_id", "text", index_name="summary"), path)
    chunks = SF.read_index(spark, path, "summary")
    emb = R.embed(chunks.select(F.concat_ws(":", "doc_id", F.col("chunk_no").cast("string")).alias("vec_id"),
                                "text"), "text", R.HashingEmbedder(64))
    qs = R.embed(X.read_table(spark, sf, "benchmark"), "text", R.HashingEmbedder(64)).select(
        F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.nearest(qs, emb, 5)
