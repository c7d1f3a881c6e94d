"""Repository-history views over the driver's TPC-H-like parquet tables.

The tables are not commit data, so fixed mappings turn them into the shapes
the operators read.  Each view exists twice: as a DataFrame (what queries
run) and as SQL text (a CTE the DuckDB oracle runs over the same parquet).

Repository key: orders-based views take the customer's region as the
repository (5 repositories, each about a fifth of the rows); the events
view is a single repository, so every operator also meets one key that holds
all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _customer_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (c_custkey, c_name, repo_owner, repo_name)."""
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = (n.join(r, n.n_regionkey == r.r_regionkey)
             .select("n_nationkey", F.lower("r_name").alias("repo_name")))
    return (cu.join(geo, cu.c_nationkey == geo.n_nationkey)
              .select("c_custkey", "c_name", F.lit("tpch").alias("repo_owner"), "repo_name"))


def _filename(p) -> "F.Column":
    return F.concat(F.lower(p.p_type), F.lit("/"),
                    F.replace(F.lower(p.p_brand), F.lit("#"), F.lit("_")), F.lit("/"),
                    F.replace(p.p_name, F.lit(" "), F.lit("_")), F.lit(".py"))


def changes_long(spark: SparkSession, sf_dir: str, with_order: bool = False) -> DataFrame:
    """One row per (commit, file): commit = order, file = part path.
    ``with_order``: the order's key stays as ``_order``, by which the rows are
    partitioned after the joins.

    Order date and customer name are constant per order, so they are
    grouping keys rather than aggregates: a filter on ``committed_at`` or
    ``author`` then passes the aggregate and the joins and reaches the
    orders / customer parquet scans.
    """
    p = read_table(spark, sf_dir, "part")
    parts = p.select("p_partkey", _filename(p).alias("filename"), "p_size", "p_name")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    oc = (o.join(_customer_repo(spark, sf_dir), o.o_custkey == F.col("c_custkey"))
           .select("o_orderkey", "o_orderdate", "c_name", "repo_owner", "repo_name"))
    lp = li.join(parts, li.l_partkey == parts.p_partkey)
    j = lp.join(oc, lp.l_orderkey == oc.o_orderkey)
    agg = (j.groupBy("repo_owner", "repo_name", "l_orderkey", "filename",
                     "o_orderdate", "c_name")
             .agg(F.sum("l_quantity").cast("bigint").alias("churn_count"),
                  F.min("p_size").alias("_size"), F.min("p_name").alias("_pname")))
    return agg.select(
        "repo_owner", "repo_name",
        F.md5(F.col("l_orderkey").cast("string")).alias("commit_hash"),
        F.lit(None).cast("double").alias("epoch"),
        F.col("o_orderdate").alias("committed_at"),
        F.col("c_name").alias("author"),
        F.lit(None).cast("string").alias("email"),
        "filename", "churn_count",
        F.when(F.col("_size") % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("edit "), F.col("_pname"))).alias("description"),
        *([F.col("l_orderkey").alias("_order")] if with_order else []),
    )


def _stream_repo(ts) -> "F.Column":
    # one repository per year of the event stream (one for the test data)
    return F.concat(F.lit("stream-"), F.year(ts).cast("string"))


def _mfgr_repo(brand) -> "F.Column":
    # one repository per manufacturer (the digit after 'Brand#')
    return F.concat(F.lit("mfgr"), F.substring(brand, 7, 1))


def changes_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes: commit = (user, day); one tag and raw weight per row.

    The commit time (first event of the user's day) comes from a grouped
    aggregate joined back, not a window: a user holding a third of all
    events would otherwise sit in one window task.
    """
    e = (read_table(spark, sf_dir, "events")
         .select("event_id", "ts", "user_id", "event_type", "value")
         .withColumn("_day", F.to_date("ts")))
    first = e.groupBy("user_id", "_day").agg(F.min("ts").alias("committed_at"))
    j = e.join(first, ["user_id", "_day"])
    return j.select(
        F.lit("events").alias("repo_owner"), _stream_repo(F.col("ts")).alias("repo_name"),
        F.col("event_id").alias("id"),
        F.md5(F.concat(F.col("user_id").cast("string"), F.lit("|"),
                       F.col("_day").cast("string"))).alias("commit_hash"),
        F.lit(None).cast("double").alias("epoch"),
        "committed_at",
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.lit(None).cast("string").alias("email"),
        F.concat(F.lit("dir"), (F.col("event_id") % 7).cast("string"), F.lit("/f"),
                 (F.col("event_id") % 101).cast("string"), F.lit(".py")).alias("filename"),
        F.floor("value").cast("bigint").alias("churn_count"),
        F.lit(None).cast("string").alias("description"),
        F.col("event_type").alias("tag"),
        F.col("value").alias("weight"),
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as pull requests; merged/closed time = the order's last ship date."""
    last = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
            .agg(F.max("l_shipdate").alias("last_ship")))
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    oc = o.join(_customer_repo(spark, sf_dir), o.o_custkey == F.col("c_custkey"))
    j = oc.join(last, oc.o_orderkey == last.l_orderkey)
    st = F.col("o_orderstatus")
    null_ts = F.lit(None).cast("timestamp_ntz")
    return j.select(
        "repo_owner", "repo_name",
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("PR "), F.col("o_orderpriority")).alias("title"),
        F.col("c_name").alias("user_login"),
        F.when(st == "O", "open").otherwise("closed").alias("state"),
        F.col("o_orderdate").alias("created_at"),
        (st == "F").alias("merged"),
        F.when(st == "F", F.col("last_ship")).otherwise(null_ts).alias("merged_at"),
        F.md5(F.col("o_orderkey").cast("string")).alias("merge_commit_sha"),
        F.lit(None).cast("string").alias("mergeable"),
        F.lit(None).cast("string").alias("mergeable_state"),
        F.lit(None).cast("int").alias("comments"),
        F.lit(None).cast("int").alias("review_comments"),
        F.when(st == "O", null_ts).otherwise(F.col("last_ship")).alias("closed_at"),
        F.lit(None).cast("string").alias("html_url"),
        F.lit(None).cast("string").alias("description"),
    )


def function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as per-function code metrics of one repository."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.lit("tpch").alias("repo_owner"), _mfgr_repo(F.col("p_brand")).alias("repo_name"),
        F.concat(F.lit("src/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")),
                 F.lit(".py")).alias("file_path"),
        F.lit("function").alias("type"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
                 k.cast("string")).alias("name"),
        F.col("p_size").alias("lines_of_code"),
        (F.lit(1) + (k % 13).cast("int")).alias("cyclomatic_complexity"),
        (k % 6).cast("int").alias("nesting_depth"),
        (k % 17).cast("int").alias("number_of_function_calls"),
        (k % 29).cast("int").alias("number_of_variables"),
        (F.col("p_size").cast("double") / 100).alias("llm_code_readability"),
    )


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL (the oracle sees only the base tables).

SQL_CUSTOMER_REPO = """customer_repo as (
  select cu.c_custkey, cu.c_name, 'tpch' as repo_owner, lower(r.r_name) as repo_name
  from customer cu join nation n on cu.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey)"""

SQL_CHANGES_LONG = SQL_CUSTOMER_REPO + """,
changes_long as (
  select min(cr.repo_owner) as repo_owner, min(cr.repo_name) as repo_name,
    md5(cast(l.l_orderkey as varchar)) as commit_hash, min(o.o_orderdate) as committed_at,
    min(cr.c_name) as author,
    concat(lower(p.p_type),'/',replace(lower(p.p_brand),'#','_'),'/',replace(p.p_name,' ','_'),'.py') as filename,
    cast(sum(l.l_quantity) as bigint) as churn_count,
    case when min(p.p_size) % 5 = 0 then null else concat('edit ', min(p.p_name)) end as description
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer_repo cr on o.o_custkey = cr.c_custkey
  join part p on l.l_partkey = p.p_partkey
  group by l.l_orderkey, 6)"""

SQL_CHANGES_SHORT = """changes_short as (
  select 'events' as repo_owner, concat('stream-', cast(year(e.ts) as varchar)) as repo_name, e.event_id as id,
    md5(concat(cast(e.user_id as varchar),'|',cast(cast(e.ts as date) as varchar))) as commit_hash,
    min(e.ts) over (partition by e.user_id, cast(e.ts as date)) as committed_at,
    concat('user', cast(e.user_id as varchar)) as author,
    concat('dir', cast(e.event_id % 7 as varchar), '/f', cast(e.event_id % 101 as varchar), '.py') as filename,
    cast(floor(e.value) as bigint) as churn_count, e.event_type as tag, e.value as weight
  from events e)"""

SQL_PULL_REQUESTS = SQL_CUSTOMER_REPO + """,
pulls as (
  select cr.repo_owner, cr.repo_name, o.o_orderkey as number,
    concat('PR ', o.o_orderpriority) as title, cr.c_name as user_login,
    case when o.o_orderstatus = 'O' then 'open' else 'closed' end as state,
    o.o_orderdate as created_at, o.o_orderstatus = 'F' as merged,
    case when o.o_orderstatus = 'F' then m.last_ship end as merged_at,
    case when o.o_orderstatus = 'O' then null else m.last_ship end as closed_at,
    md5(cast(o.o_orderkey as varchar)) as merge_commit_sha,
    cast(null as varchar) as html_url, cast(null as varchar) as description
  from orders o join customer_repo cr on o.o_custkey = cr.c_custkey
  join (select l_orderkey, max(l_shipdate) as last_ship from lineitem group by 1) m
    on m.l_orderkey = o.o_orderkey)"""

SQL_FUNCTIONS = """functions as (
  select 'tpch' as repo_owner, concat('mfgr', substr(p_brand, 7, 1)) as repo_name,
    concat('src/', replace(lower(p_brand),'#','_'), '.py') as file_path, 'function' as type,
    concat(replace(p_name,' ','_'), '_', cast(p_partkey as varchar)) as name,
    p_size as lines_of_code, 1 + cast(p_partkey % 13 as int) as cyclomatic_complexity,
    cast(p_partkey % 6 as int) as nesting_depth, cast(p_partkey % 17 as int) as number_of_function_calls,
    cast(p_partkey % 29 as int) as number_of_variables,
    cast(p_size as double) / 100 as llm_code_readability
  from part)"""


def sql_with(*ctes: str) -> str:
    """``with`` prefix joining CTE texts, dropping repeats of customer_repo."""
    seen, parts = set(), []
    for c in ctes:
        for piece in _split_ctes(c):
            name = piece.split(" as (", 1)[0].strip()
            if name not in seen:
                seen.add(name)
                parts.append(piece.strip())
    return "with " + ",\n".join(parts) + "\n"


def _split_ctes(text: str) -> list[str]:
    out, depth, cur = [], 0, []
    for ch in text:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append("".join(cur))
            cur = []
            continue
        cur.append(ch)
    if "".join(cur).strip():
        out.append("".join(cur))
    return out


def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag dimension of the events repository: its distinct event types,
    ids in name order (the window runs over the distinct names only)."""
    from pyspark.sql import Window
    names = (read_table(spark, sf_dir, "events")
             .select(F.lit("events").alias("repo_owner"), _stream_repo(F.col("ts")).alias("repo_name"),
                     F.col("event_type").alias("name"))
             .distinct())
    w = Window.partitionBy("repo_owner", "repo_name").orderBy("name")
    return names.select("repo_owner", "repo_name",
                        F.row_number().over(w).cast("int").alias("tag_id"), "name")


def event_commit_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_tags of the events repository: each change's raw weight over
    the sum of its commit's weights (exact decimal sum), with the tag id.

    The per-commit sum is an aggregate joined back (not a window), so a
    commit holding a third of all rows is summed map-side in pieces.  Over a
    sum of zero the share is what the SQL view has, NaN or infinite.
    """
    ch = changes_short(spark, sf_dir)
    tot = (ch.groupBy("repo_owner", "repo_name", "commit_hash")
           .agg(F.sum(F.col("weight").cast("decimal(18,6)")).alias("_s")))
    tags = event_tags(spark, sf_dir)
    w, s = F.col("weight"), F.col("_s").cast("double")
    share = F.when(s == 0, w * F.lit(float("inf"))).otherwise(w / s)
    return (ch.join(tot, ["repo_owner", "repo_name", "commit_hash"])
            .join(tags.withColumnRenamed("name", "tag"),
                  ["repo_owner", "repo_name", "tag"])
            .select("repo_owner", "repo_name", "id", "tag_id",
                    share.alias("value")))


def event_tag_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier-style answer per event change, built from its type,
    value and ``k`` property: an unknown name, a repeated name (the last
    weight wins), a bad weight and a zero total all occur."""
    e = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")
    resp = F.concat(F.col("event_type"), F.lit(","), F.floor("value").cast("bigint").cast("string"),
                    F.lit(",Bogus,3,click,"), (k % 7).cast("string"), F.lit(","),
                    F.col("event_type"), F.lit(","), (k % 10).cast("string"), F.lit(",Docs,x"))
    return e.select(F.lit("events").alias("repo_owner"), _stream_repo(F.col("ts")).alias("repo_name"),
                    F.col("event_id").alias("id"), resp.alias("response"))


SQL_TAGS = """tags_dim as (
  select repo_owner, repo_name,
    cast(row_number() over (partition by repo_owner, repo_name order by event_type) as integer) as tag_id,
    event_type as name
  from (select distinct 'events' as repo_owner, concat('stream-', cast(year(ts) as varchar)) as repo_name,
          event_type from events) d)"""

SQL_COMMIT_TAGS = SQL_CHANGES_SHORT + ",\n" + SQL_TAGS + """,
ctags as (
  select s.repo_owner, s.repo_name, s.id, t.tag_id,
    s.weight / cast(sum(cast(s.weight as decimal(18,6))) over (
      partition by s.repo_owner, s.repo_name, s.commit_hash) as double) as value
  from changes_short s join tags_dim t
    on s.repo_owner = t.repo_owner and s.repo_name = t.repo_name and s.tag = t.name)"""

SQL_TAG_RESPONSES = """responses as (
  select 'events' as repo_owner, concat('stream-', cast(year(ts) as varchar)) as repo_name, event_id as id,
    concat(event_type, ',', cast(cast(floor(value) as bigint) as varchar), ',Bogus,3,click,',
      cast(cast(regexp_extract(props, '"k": (\\d+)', 1) as integer) % 7 as varchar), ',', event_type, ',',
      cast(cast(regexp_extract(props, '"k": (\\d+)', 1) as integer) % 10 as varchar), ',Docs,x') as response
  from events)"""


# Fixed value: functions per generated source file (bounds a file's size).
FUNCTIONS_PER_FILE = 100


def part_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python source files generated from ``part``: one function per part,
    files of at most 100 functions per brand (so a file's text never grows
    with the table).  Columns: repo, file_path, content."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("f_"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"),
                    F.lit("_"), k.cast("string"))
    size = F.col("p_size").cast("string")
    loop = F.when(k % 2 == 0, F.concat(
        F.lit("    for i in range(x):\n        if i % "), (k % 7 + 2).cast("string"),
        F.lit(" == 0:\n            total += step(i)\n"))).otherwise(F.lit(""))
    fn = F.concat(F.lit("def "), name, F.lit("(x):\n    \"\"\""), F.col("p_name"),
                  F.lit("\"\"\"\n    total = "), size, F.lit("\n    if x > "), size,
                  F.lit(":\n        total = total + scale(x)\n"), loop,
                  F.lit("    return total\n"))
    path = F.concat(F.lit("src/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")),
                    F.lit("/mod_"), F.floor(k / FUNCTIONS_PER_FILE).cast("string"), F.lit(".py"))
    rows = p.select(_mfgr_repo(F.col("p_brand")).alias("repo_name"), path.alias("file_path"),
                    k.alias("_k"), fn.alias("_fn"))
    files = (rows.groupBy("repo_name", "file_path")
             .agg(F.array_sort(F.collect_list(F.struct("_k", "_fn"))).alias("_fs")))
    return files.select(
        F.lit("tpch").alias("repo_owner"), "repo_name", "file_path",
        F.concat(F.lit("import math\nfrom os import path\n\nLIMIT = 10\n\n"),
                 F.array_join(F.transform("_fs", lambda s: s["_fn"]), "\n\n")).alias("content"))
