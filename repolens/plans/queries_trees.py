"""Registered queries over source trees of many repositories: reading them
(S8), ignore rules as data (S9), repo maps with a fixed schema (S10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import source_files as SF
from .registry import query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
LINES_PER_FILE = 1000


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


@query("source_tree", f"""with lines as (
  select concat('mfgr', substr(p_brand, 7, 1)) as repo_name, concat('mod_', cast(p_partkey // {LINES_PER_FILE} as varchar)) as file,
    p_partkey as k, concat(cast(p_partkey as varchar), ' = "', p_name, ' é"') as line from part)
select 'tpch' as repo_owner, repo_name, file, 'file' as kind, cast(sum(strlen(line) + 1) as bigint) as bytes, count(*) as lines,
  md5(string_agg(concat(line, chr(10)), '' order by k)) as content_md5
from lines group by repo_name, file
union all select 'tpch', repo_name, 'blob', 'not UTF-8', null, null, null from (select distinct repo_name from lines)""")
def q_source_tree(spark, sf):
    # S8 in read-all mode: a tree of one repository per manufacturer, each
    # with text files (parts as lines, with characters beyond ASCII) and one
    # compressed file, which is a reject.
    root = _tmp(spark, "trees")
    p = X.read_table(spark, sf, "part")
    k = F.col("p_partkey")
    lines = p.select(F.lit("tpch").alias("repo_owner"), X._mfgr_repo(F.col("p_brand")).alias("repo_name"),
                     F.concat(F.lit("mod_"), F.floor(k / LINES_PER_FILE).cast("string")).alias("file"), k.alias("k"),
                     F.concat(k.cast("string"), F.lit(' = "'), "p_name", F.lit(' é"')).alias("line"))
    files = lines.groupBy(*REPO, "file").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    (files.select(*REPO, "file", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("value"))
     .repartition("repo_name", "file").write.partitionBy(*REPO, "file").text(root))
    (lines.select(*REPO, F.lit("blob").alias("file"), F.col("repo_name").alias("value")).distinct()
     .write.mode("append").option("compression", "gzip").partitionBy(*REPO, "file").text(root))
    files, rejects = SF.read_source_tree(spark, root, exts=None)
    name = F.regexp_extract("file_path", "file=([^/]+)/", 1)
    null = lambda kind: F.lit(None).cast(kind)
    good = files.select(*REPO, name.alias("file"), F.lit("file").alias("kind"), F.octet_length("content").cast("bigint").alias("bytes"),
                        (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).cast("bigint").alias("lines"),
                        F.md5("content").alias("content_md5"))
    bad = rejects.select(*REPO, name.alias("file"), F.col("reason").alias("kind"), null("bigint").alias("bytes"), null("bigint").alias("lines"),
                         null("string").alias("content_md5"))
    return good.unionByName(bad)


# Ignore files of two repositories: (repo_name, folder, lines).
IGNORE_FILES = [
    ("asia", "", ["# generated", "promo*/", "*_anvil.py", "", "!*red_anvil.py", "/economy/brand_1?/"]),
    ("asia", "economy", ["brand_2*/", "!brand_23/", "brand_[4-6]/*_r*.py"]),
    ("europe", "", ["*.py", "!small*/", "**/brand_1?/*gear*"]),
]


@query("source_tree_ignored", LONG + r""", f as (
  select distinct repo_owner, repo_name, filename,
    split_part(filename, '/', 1) as dir, split_part(filename, '/', 2) as brand, split_part(filename, '/', 3) as base
  from changes_long)
select repo_owner, repo_name, filename from f
where not case repo_name
  when 'asia' then case
    when dir = 'economy' and regexp_matches(brand, '^brand_[4-6]$') and regexp_matches(base, '_r.*\.py$') then true
    when dir = 'economy' and brand = 'brand_23' then false
    when dir = 'economy' and regexp_matches(brand, '^brand_2') then true
    when dir = 'economy' and regexp_matches(brand, '^brand_1.$') then true
    when regexp_matches(base, 'red_anvil\.py$') then false
    when regexp_matches(base, '_anvil\.py$') then true
    else dir like 'promo%' end
  when 'europe' then case
    when regexp_matches(brand, '^brand_1.$') and base like '%gear%' then true
    else not dir like 'small%' end
  else false end""")
def q_source_tree_ignored(spark, sf):
    # Rules of two repositories, nested folders and negations in one job
    rows = [("tpch", repo, folder, n, line) for repo, folder, lines in IGNORE_FILES for n, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "repo_owner string, repo_name string, folder string, line_no int, line string")
    files = X.changes_long(spark, sf).select(*REPO, "filename").distinct()
    return SF.filter_by_rules(files, SF.ignore_rules(lines), "filename")


@query("repo_map_read", f"""with fn as (
  select concat('mfgr', substr(p_brand, 7, 1)) as repo_name, concat('src/mod_', cast(p_partkey // {LINES_PER_FILE} as varchar), '.py') as file_path,
    p_size as loc, cast(p_partkey % 13 as int) as cc from part)
select 'tpch' as repo_owner, repo_name, file_path, count(*) as definitions, cast(sum(loc) as bigint) as lines,
  cast(max(cc) as int) as max_cc, 1 as imports
from fn group by repo_name, file_path
union all select 'tpch', repo_name, 'corrupt', 1, null, null, null from (select distinct repo_name from fn)""")
def q_repo_map_read(spark, sf):
    # One JSON document per file, one corrupt line per repository; read
    # back with the fixed nested schema
    p = X.read_table(spark, sf, "part")
    k = F.col("p_partkey")
    fns = p.select(F.lit("tpch").alias("repo_owner"), X._mfgr_repo(F.col("p_brand")).alias("repo_name"),
                   F.concat(F.lit("src/mod_"), F.floor(k / LINES_PER_FILE).cast("string"), F.lit(".py")).alias("file_path"),
                   F.lit("function").alias("type"), F.col("p_name").alias("name"), F.col("p_size").alias("lines_of_code"),
                   (k % 13).cast("int").alias("cyclomatic_complexity"))
    top = fns.select(*REPO, "file_path").distinct().select(
        "*", F.lit(".py").alias("file_extension"), F.array(F.lit("import math")).alias("imports"), F.array(F.lit("X = 1")).alias("code"))
    path = _tmp(spark, "repomap")
    SF.write_repo_map(fns, top, path)
    (fns.select(*REPO).distinct().withColumn("value", F.lit('{"file_path": "src/cut.py", "functions": [{"name"'))
     .write.mode("append").partitionBy(*REPO).text(path))
    docs, top = SF.read_repo_map(spark, path)
    good = (docs.groupBy(*REPO, "file_path").agg(F.count(F.lit(1)).alias("definitions"), F.sum("lines_of_code").alias("lines"),
                                                 F.max("cyclomatic_complexity").alias("max_cc"))
            .join(top.select(*REPO, "file_path", F.size("imports").alias("imports")), [*REPO, "file_path"]))
    bad = SF.repo_map_rejects(spark, path).groupBy(*REPO).agg(F.count(F.lit(1)).alias("definitions")).select(
        *REPO, F.lit("corrupt").alias("file_path"), "definitions", F.lit(None).cast("bigint").alias("lines"),
        F.lit(None).cast("int").alias("max_cc"), F.lit(None).cast("int").alias("imports"))
    return good.unionByName(bad)
