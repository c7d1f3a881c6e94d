"""Registered retrieval and annotation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..operators import annotate as L
from ..operators import load as U
from ..operators import pulls as P
from ..operators import retrieve as R
from ..operators import activity as A
from ..operators import churn as C
from ..operators import code_metrics as M
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as X
from .params import LONG_AS_OF
from .registry import query


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


NEAREST_K = 5

# What Python's str.split() takes for words, as a pattern of the oracle's engine.
_WORD = r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def extract_sql(prompt: str, n: int) -> str:
    """The offline completer in SQL: ``n`` words of the prompt, evenly spread."""
    return (f"(select array_to_string(list_transform(range(0, least({n}, len(w))), lambda i: w[(i * len(w)) // least({n}, len(w)) + 1]), ' ') "
            f"from (select regexp_extract_all({prompt}, '{_WORD}') as w))")


def _route_sql(text: str) -> str:
    """The offline router in SQL: shared words of four letters and more, ties to the earlier tool."""
    router = L.Router(R.TOOLS)
    words = f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 4))"
    score = {t: f"len(list_intersect({words}, [{', '.join(repr(x) for x in sorted(router._words(d)))}]))" for t, d in R.TOOLS.items()}
    best = "greatest(" + ", ".join(score.values()) + ")"
    return "case " + " ".join(f"when {x} = {best} then '{t}'" for t, x in score.items()) + " end"


_NEAREST_SQL = f"""with dims as (
  select label, pos, avg(cast(x as double)) as m
  from (select label, pos, embedding[pos] as x from (
          select label, embedding, unnest(range(1, len(embedding) + 1)) as pos from embeddings) u) t
  group by 1, 2),
cent as (select label, list(m order by pos) as c from dims group by 1),
sims as (
  select c.label as query_id, e.vec_id,
    list_cosine_similarity(c.c, cast(e.embedding as double[])) as sim
  from cent c, embeddings e)
select query_id, rank, vec_id, cast(round(cast(sim as decimal(18,9)), 4) as decimal(18,4)) as sim from (
  select *, cast(row_number() over (partition by query_id order by sim desc, vec_id) as integer) as rank
  from sims) t where rank <= {NEAREST_K}"""


@query("nearest_centroids", _NEAREST_SQL)
def q_nearest_centroids(spark, sf):
    # The nearest vectors to each label's mean vector
    emb = X.read_table(spark, sf, "embeddings")
    q = R.centroids(emb, "label").select(F.col("label").alias("query_id"), F.col("centroid").alias("query"))
    nn = R.nearest(q, emb, NEAREST_K)
    return nn.select("query_id", "rank", "vec_id",
                     F.round(F.col("sim").cast("decimal(18,9)"), 4).cast("decimal(18,4)").alias("sim"))


@query("nearest_indexed", _NEAREST_SQL)
def q_nearest_indexed(spark, sf):
    # R5 over the stored index: the same neighbours, from the cells whose
    # bounds allow them
    from ..operators import vector_index as V
    emb = X.read_table(spark, sf, "embeddings")
    path = _tmp(spark, "vector-index")
    V.write_vector_index(emb, path)
    q = R.centroids(emb, "label").select(F.col("label").alias("query_id"), F.col("centroid").alias("query"))
    nn = V.search_vector_index(spark, path, q, NEAREST_K)
    return nn.select("query_id", "rank", "vec_id",
                     F.round(F.col("sim").cast("decimal(18,9)"), 4).cast("decimal(18,4)").alias("sim"))


@query("chunk_documents")
def q_chunk_documents(spark, sf):
    """Sentence-packed chunks of every document (whole texts)."""
    d = X.read_table(spark, sf, "documents")
    return R.chunk(d, "doc_id", "text", index_name="summary", meta_cols=["lang", "source"])


@query("chunk_coverage", """select lang, count(*) as documents,
  cast(sum(length(text) - length(replace(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''), chr(13), ''))) as bigint) as blanks
from documents group by 1""")
def q_chunk_coverage(spark, sf):
    # R1 check against plain SQL: every non-blank character of every
    # document lands in exactly one chunk when the overlap is 0, so the
    # non-blank character count per language is unchanged by chunking.
    d = X.read_table(spark, sf, "documents")
    ch = R.chunk(d, "doc_id", "text", overlap=0, meta_cols=["lang"])
    nb = F.length(F.regexp_replace("text", r"[ \n\t\r]", ""))
    per_doc = ch.groupBy("doc_id", F.col("metadata")["lang"].alias("lang")).agg(F.sum(nb).alias("nb"))
    src = d.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    tot = src.join(per_doc.select("doc_id", "nb"), "doc_id", "left")
    return (tot.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        (F.sum(F.length("text")) - F.sum(F.coalesce("nb", F.lit(0)))).cast("bigint").alias("blanks")))


@query("describe_documents", f"""select doc_id, {extract_sql("concat('Filename: ', doc_id, chr(10), 'File Content:', chr(10), coalesce(text, ''))", 30)} as description
from documents""")
def q_describe_documents(spark, sf):
    """One described row per document through the cached
    annotate operator (offline extractive completer)."""
    d = X.read_table(spark, sf, "documents")
    p = L.render(L.TEMPLATES["summarize_diff"], filename=F.col("doc_id").cast("string"),
                 clause=F.lit("File Content:"), data="text")
    out = L.annotate(d.select("doc_id", "text"), p, L.ExtractiveCompleter(30),
                     _tmp(spark, "cache"), model="offline|extractive", out="description")
    return out.select("doc_id", "description")


def _shorten_sql(words: int) -> str:
    """Five rounds of shortening what is still too long."""
    rounds = ["r0 as (select cast(doc_id as varchar) as filename, text as t from documents)"]
    for i in range(1, L.SHORTEN_ROUNDS + 1):
        prompt = "concat('Filename: ', filename, chr(10), 'Shorten this summary:', chr(10), t)"
        rounds.append(f"r{i} as (select filename, case when length(trim(t)) > {L.MAX_DESCRIPTION} then {extract_sql(prompt, words)} else t end as t from r{i - 1})")
    return "with " + ",\n".join(rounds) + (f"\nselect filename, case when length(trim(t)) <= {L.MAX_DESCRIPTION} then t end as description "
                                           f"from r{L.SHORTEN_ROUNDS}")


@query("shorten_descriptions", _shorten_sql(100))
def q_shorten_descriptions(spark, sf):
    """L3: long descriptions are shortened in at most 5 rounds."""
    d = X.read_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("description"))
    cache = _tmp(spark, "cache")
    return L.shorten(d, "description", L.ExtractiveCompleter(100), cache, max_len=L.MAX_DESCRIPTION)


@query("tree_summary")
def q_tree_summary(spark, sf):
    """One summary per language over all its document chunks."""
    d = X.read_table(spark, sf, "documents")
    ch = R.chunk(d, "doc_id", "text", meta_cols=["lang"]).select(
        F.col("metadata")["lang"].alias("lang"),
        F.concat_ws(":", F.lpad("doc_id", 12, "0"), F.lpad(F.col("chunk_no").cast("string"), 6, "0")).alias("_o"),
        "text")
    return R.tree_summarise(ch, ["lang"], "_o", "text", L.ExtractiveCompleter(60), _tmp(spark, "cache"))


@query("route_questions", f"""select item_id, {_route_sql("coalesce(text, '')")} as index_name from benchmark""")
def q_route_questions(spark, sf):
    """Each benchmark passage as a question, routed to one index."""
    b = X.read_table(spark, sf, "benchmark")
    tools = R.TOOLS
    return R.route(b, "text", L.Router(tools), _tmp(spark, "cache")).select("item_id", "index_name")


@query("function_source_docs")
def q_function_source_docs(spark, sf):
    """Description and source documents of the parsed functions."""
    path = _tmp(spark, "functions")
    M.extract_functions(X.part_source_files(spark, sf)).write.parquet(path)
    fns = spark.read.parquet(path).withColumn("description", F.col("docstring"))
    a = R.description_docs(fns).withColumn("index_name", F.lit("vector"))
    b = R.source_docs(fns).withColumn("index_name", F.lit("code_vector"))
    return a.unionByName(b)


@query("pr_summaries", X.sql_with(X.SQL_CHANGES_LONG, X.SQL_PULL_REQUESTS) + f""", t as (
  select p.repo_owner, p.repo_name, p.number,
    coalesce(string_agg(d.description, chr(10) || '--' || chr(10) order by d.filename), '') as text
  from pulls p left join changes_long d on p.repo_owner = d.repo_owner and p.repo_name = d.repo_name
    and p.merge_commit_sha = d.commit_hash and d.description is not null where p.description is null group by 1, 2, 3)
select repo_owner, repo_name, number, {extract_sql("concat('Summarize these change descriptions:', chr(10), text)", 25)} as summary from t""")
def q_pr_summaries(spark, sf):
    """PR text (A17) summarised through annotate."""
    t = P.pr_text(X.pull_requests(spark, sf), X.changes_long(spark, sf))
    p = L.render(L.TEMPLATES["summarize_pr"], prs="text")
    return L.annotate(t, p, L.ExtractiveCompleter(25), _tmp(spark, "cache"), out="summary") \
        .select(*REPO, "number", "summary")


def _datasets(spark, sf):
    # the changes table is written once and read by the data sets
    path = _tmp(spark, "changes")
    X.changes_long(spark, sf).write.parquet(path)
    ch = spark.read.parquet(path)
    from ..operators import tags as G
    ct, tags, short = X.event_commit_tags(spark, sf), X.event_tags(spark, sf), X.changes_short(spark, sf)
    sets = {
        "author-commits-summary": A.author_tenure(ch),
        "file-commit-count-summary": A.file_commit_counts(ch),
        "commit-count-by-date-summary": A.commits_by_date(ch, LONG_AS_OF),
        "churn-summary": C.churn_tree(ch),
        "overall-tags-summary": G.tag_totals(ct, tags),
        "tags-by-week-summary": G.tag_share_matrix(ct, tags, short, ["id"]),
    }
    spans = A.date_span(ch).unionByName(A.date_span(short))
    return sets, spans


def _summaries(spark, sf):
    sets, spans = _datasets(spark, sf)
    path = _tmp(spark, "summaries")
    L.summarise_datasets(sets, spans, None, L.ExtractiveCompleter(20), _tmp(spark, "cache"),
                         created_at=LONG_AS_OF).write.parquet(path)
    return spark.read.parquet(path)


@query("latest_summaries")
def q_latest_summaries(spark, sf):
    """The six data sets summarised once per content key,
    then the latest per (repo, name) with display dates."""
    return U.summary_for_display(_summaries(spark, sf))


@query("summary_catalogue")
def q_summary_catalogue(spark, sf):
    """K13-K15 over the summaries table: distinct names, by model, in a
    date range (one row per catalogue answer)."""
    from ..operators import catalogue as K
    s = _summaries(spark, sf)
    a = K.summary_names(s).select(*REPO, F.lit("K13").alias("query"), "name")
    b = K.summaries_by_model(s, "extractive").select(*REPO, F.lit("K14").alias("query"), "name")
    c = K.summaries_in_range(s, "1990-01-01", "2001-12-31").select(*REPO, F.lit("K15").alias("query"), "name")
    return a.unionByName(b).unionByName(c)


@query("stored_answers", """with d as (select doc_id, coalesce(text, '') as text from documents),
t as (select text, min(case when doc_id % 2 = 0 then 1 else 2 end) as run from d group by text)
select run, cast(sum(case when r = run then 1 else 0 end) as bigint) as answers, cast(sum(case when r = run then 1 else 0 end) as bigint) as vectors,
  (select count(*) from d where run >= 2 or doc_id % 2 = 0) as documents
from (select t.run as r, runs.run from t, (values (1), (2), (3)) as runs(run)) x group by run""")
def q_stored_answers(spark, sf):
    # Half of the documents, all of them, and all of them again are
    # answered and embedded through one store; each run's new entries, and
    # the documents that have an answer and a vector afterwards
    d = X.read_table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = _tmp(spark, "store")
    from ..operators.store import drop_kept_rows, read_store
    out, before = None, (0, 0)
    for run, docs in ((1, d.filter("doc_id % 2 = 0")), (2, d), (3, d)):
        with drop_kept_rows(spark):
            answered = L.annotate(docs, F.col("text"), L.ExtractiveCompleter(10), path, out="answer")
            full = R.embed(answered, "text", R.HashingEmbedder(16), store_path=path).filter("answer is not null and embedding is not null")
            now = read_store(spark, path).agg(F.count("answer"), F.count("vector")).first()
            # computed before the run's rows are deleted
            row = cut_lineage(full.agg(F.lit(run).alias("run"), F.lit(now[0] - before[0]).cast("bigint").alias("answers"),
                                       F.lit(now[1] - before[1]).cast("bigint").alias("vectors"), F.count(F.lit(1)).alias("documents")))
        out, before = row if out is None else out.unionByName(row), tuple(now)
    return out


@query("routed_search", f"""with e as (
  select vec_id, case label % 3 when 0 then 'summary' when 1 then 'vector' else 'code_vector' end as index_name,
    cast(embedding as double[]) as v from embeddings),
q as (select vec_id as query_id, case when vec_id % 2 = 0 then 'vector' else 'summary' end as index_name, v from e where vec_id % 25 = 0),
s as (select q.query_id, e.index_name, e.vec_id, list_cosine_similarity(q.v, e.v) as sim from q join e using (index_name))
select query_id, index_name, rank, vec_id, cast(round(cast(sim as decimal(18,9)), 4) as decimal(18,4)) as sim from (
  select *, cast(row_number() over (partition by query_id order by sim desc, vec_id) as integer) as rank from s) t where rank <= {NEAREST_K}""")
def q_routed_search(spark, sf):
    # Vectors stored as three indexes, by their label; questions
    # routed to two of them are answered from their own index, and the third
    # is never opened
    from ..sources import source_files as SF
    emb = X.read_table(spark, sf, "embeddings")
    name = lambda n: F.element_at(F.array(*[F.lit(t) for t in ("summary", "vector", "code_vector")]), n + 1)
    path = _tmp(spark, "indexes")
    SF.write_index(emb.select("vec_id", "embedding", name((F.col("label") % 3).cast("int")).alias("index_name")), path)
    asked = emb.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"),
                                                 name(F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0)).alias("index_name"))
    return R.search_routed(asked, SF.read_index(spark, path), NEAREST_K).withColumn(
        "sim", F.round(F.col("sim").cast("decimal(18,9)"), 4).cast("decimal(18,4)"))


@query("ask_questions")
def q_ask_questions(spark, sf):
    """R7 -> R4 -> S14 -> R5: benchmark passages as questions, routed, then
    answered from their own index: document chunks (summary), chunk heads
    (vector) or the chunks' first sentences (code_vector)."""
    from ..sources import source_files as SF
    ch = R.chunk(X.read_table(spark, sf, "documents"), "doc_id", "text", overlap=0)
    chunk_id = F.concat_ws(":", "doc_id", F.col("chunk_no").cast("string")).alias("vec_id")
    texts = {"summary": F.col("text"), "vector": F.substring("text", 1, 200), "code_vector": F.element_at(F.split("text", r"(?<=[.!?])\\s+"), 1)}
    rows = None
    for name, text in texts.items():
        part = ch.select(chunk_id, text.alias("text"), F.lit(name).alias("index_name"))
        rows = part if rows is None else rows.unionByName(part)
    path, store = _tmp(spark, "indexes"), _tmp(spark, "store")
    SF.write_index(R.embed(rows, "text", R.HashingEmbedder(64), store_path=store), path)
    b = R.route(X.read_table(spark, sf, "benchmark"), "text", L.Router(R.TOOLS), _tmp(spark, "cache"))
    qs = R.embed(b.select("item_id", "text", "index_name"), "text", R.HashingEmbedder(64), "query", store_path=store)
    return R.search_routed(qs, SF.read_index(spark, path), 3, q_id="item_id").select(F.col("query_id").alias("item_id"), "index_name", "rank", "vec_id")


def _function_docs_sql() -> str:
    from .queries_code import SQL_PARSED
    return "with " + SQL_PARSED + """
select repo_owner, repo_name, 'vector' as index_name, docstring as text, file_path as filename, name as function_name, cast(null as boolean) as placed from parsed
union all select repo_owner, repo_name, 'code_vector', code, file_path, name, true from parsed"""


@query("function_docs", _function_docs_sql())
def q_function_docs(spark, sf):
    # Description and source documents of the parsed functions, with
    # the fields of their metadata
    path = _tmp(spark, "functions")
    M.extract_functions(X.part_source_files(spark, sf)).write.parquet(path)
    fns = spark.read.parquet(path).withColumn("description", F.col("docstring"))
    docs = (R.description_docs(fns).withColumn("index_name", F.lit("vector"))
            .unionByName(R.source_docs(fns).withColumn("index_name", F.lit("code_vector"))))
    field = lambda name: F.try_element_at("metadata", F.lit(name))
    return docs.select(*REPO, "index_name", "text", field("filename").alias("filename"), field("function_name").alias("function_name"),
                       field("location").isNotNull().alias("placed")).withColumn("placed", F.when(F.col("placed"), F.lit(True)))
