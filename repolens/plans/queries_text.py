"""Registered queries of the text rules over data that meets their cases
(P5, P6, P9, P11-P19), of pull requests joined with changes (J3), and of tag
and cost rows that are there already (G4, A8, S6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import REPO
from ..functions import text as P
from ..functions import time as T
from ..operators import annotate as L
from ..operators import pulls as PR
from ..operators import tags as G
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import logs as LG
from .queries_sources import DEFAULT_MODEL, DEFAULT_SERVICE, PRICES
from .registry import query

LONG = X.sql_with(X.SQL_CHANGES_LONG)
PL = X.sql_with(X.SQL_CHANGES_LONG, X.SQL_PULL_REQUESTS)
EXTS = [".py", ".md", ".PNG", ".lock", ".env.local", "", ".tar.gz", ".ipynb"]


def _tmp(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


@query("pull_changes", PL + """select p.repo_owner, p.repo_name, p.number, p.state, p.user_login, c.commit_hash, c.committed_at, c.author,
  c.filename, c.churn_count
from pulls p join changes_long c on p.repo_owner = c.repo_owner and p.repo_name = c.repo_name and p.merge_commit_sha = c.commit_hash""")
def q_pull_changes(spark, sf):
    # Every change row of every pull request's merge commit
    return PR.pull_changes(X.pull_requests(spark, sf), X.changes_long(spark, sf)).select(
        *REPO, "number", "state", "user_login", "commit_hash", "committed_at", "author", "filename", "churn_count")


@query("clean_texts", r"""select doc_id, replace(replace(m, chr(10), ' '), '--', ' ') as message, translate(m, chr(9) || chr(13) || chr(10), '   ') as title,
  coalesce(nullif(trim(a), ''), 'Unknown') as author
from (select doc_id, concat(substr(text, 1, 80), '--', chr(9), doc_id, chr(10), '---', chr(13), substr(text, 1, 5)) as m,
  case doc_id % 4 when 0 then '' when 1 then null when 2 then '  ' else concat(' ', source) end as a from documents)""")
def q_clean_texts(spark, sf):
    # Messages with line ends, tabs and separators in them; authors
    # that are missing, empty or blank
    d = X.read_table(spark, sf, "documents")
    k, head = F.col("doc_id"), F.coalesce("text", F.lit(""))
    m = F.concat(F.substring(head, 1, 80), F.lit("--\t"), k.cast("string"), F.lit("\n---\r"), F.substring(head, 1, 5))
    a = F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, "  ").otherwise(F.concat(F.lit(" "), F.coalesce("source", F.lit(""))))
    return d.select("doc_id", P.clean_message(m).alias("message"), P.clean_title(m).alias("title"), P.unknown_author(a).alias("author"))


_PATH = """concat(case p_partkey % 5 when 0 then '.hidden/' when 1 then 'src/.d/' else 'src/' end, lower(p_type), '/', replace(p_name, ' ', '.'), '/',
  case when p_partkey % 7 = 0 then '.' else '' end, 'f', p_partkey, [{}][cast(p_partkey % 8 as int) + 1])""".format(", ".join(f"'{e}'" for e in EXTS))


@query("file_paths", rf"""with p as (select p_partkey as k, {_PATH} as path from part),
b as (select *, regexp_extract(path, '[^/]*$') as leaf, regexp_replace(regexp_extract(path, '[^/]*$'), '^\.+', '') as body from p),
e as (select *, case when body like '%.%' then regexp_extract(body, '\.[^.]*$') else '' end as ext from b),
r as (select *, case k % 4 when 0 then concat('src/{{', k, ' => new}}/', leaf) when 1 then concat('src/{{ => new}}/', leaf)
  when 2 then concat(path, ' => moved/', leaf) else path end as renamed, case when k % 2 = 0 then concat('/tmp/o-r/_source/', path) else path end as copied from e)
select k, path, leaf, cast(len(string_split(path, '/')) - 1 as int) as depth, string_split(path, '/')[1] as top,
  ext not in ({", ".join(f"'{e}'" for e in P.NON_CODE_EXTENSIONS)}) and not substr(path, 1, length(path) - length(ext)) like '.%' as code,
  case k % 4 when 0 then concat('src/', k, '/', leaf) when 1 then concat('src/', leaf) else path end as old_path, path as rel
from r""")
def q_file_paths(spark, sf):
    # Code and other extensions, hidden files and folders,
    # copied trees, renames in part and in whole
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, ".hidden/").when(k % 5 == 1, "src/.d/").otherwise("src/")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (k % 8).cast("int") + 1)
    path = F.concat(folder, F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("/"),
                    F.when(k % 7 == 0, ".").otherwise(""), F.lit("f"), k.cast("string"), ext)
    p = X.read_table(spark, sf, "part").select(k.alias("k"), path.alias("path"))
    folders, leaf = P.path_parts("path")
    k, new = F.col("k"), F.col("k") % 4
    renamed = (F.when(new == 0, F.concat(F.lit("src/{"), k.cast("string"), F.lit(" => new}/"), leaf))
               .when(new == 1, F.concat(F.lit("src/{ => new}/"), leaf)).when(new == 2, F.concat("path", F.lit(" => moved/"), leaf)).otherwise(F.col("path")))
    copied = F.when(k % 2 == 0, F.concat(F.lit("/tmp/o-r/_source/"), "path")).otherwise(F.col("path"))
    return p.select("k", "path", leaf.alias("leaf"), F.size(folders).alias("depth"), F.element_at(folders, 1).alias("top"), P.is_code_file("path").alias("code"),
                    P.resolve_rename(renamed).alias("old_path"), P.rel_path(copied).alias("rel"))


@query("highlighted_names", r"""with t as (select p_partkey, concat('||', split_part(p_name, ' ', 1), '|| of ||', p_brand, '|| and || no end') as t,
  p_retailprice * 1.005 as price from part)
select p_partkey, regexp_replace(t, '\|\|(.+?)\|\|', '<span class="highlight">\1</span>', 'g') as marked,
  array_to_string(regexp_extract_all(t, '\|\|(.+?)\|\|', 1), ',') as words, cast(round(cast(price as decimal(38,6)), 2) as decimal(38,2))::varchar as price
from t""")
def q_highlighted_names(spark, sf):
    # Markers in running text, prices as text
    p = X.read_table(spark, sf, "part")
    t = F.concat(F.lit("||"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("|| of ||"), "p_brand", F.lit("|| and || no end"))
    return p.select("p_partkey", P.highlight(t).alias("marked"), F.array_join(P.highlights(t), ",").alias("words"),
                    P.fmt2(F.col("p_retailprice") * 1.005).alias("price"))


@query("content_keys", r"""select doc_id, sha256(concat(md5(cast(doc_id as varchar)), '-', 'doc/', doc_id, '.py')) as diff_key, md5(text) as code_key,
  md5('score' || chr(9) || text) as score_key, coalesce(source, '') as service, coalesce(lang, '') as model,
  regexp_replace(replace(text, chr(10), '<BR>'), '[1-9]\. ', '&nbsp;&#8226;&nbsp;', 'g') as shown, strftime(date '2024-01-01' + cast(doc_id % 400 as int), '%m/%d/%Y') as day
from documents""")
def q_content_keys(spark, sf):
    # P12, P13, P15, P16 over whole texts
    d = X.read_table(spark, sf, "documents")
    k = F.col("doc_id")
    service, model = P.split_model(F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit(""))))
    return d.select("doc_id", P.diff_key(F.md5(k.cast("string")), F.concat(F.lit("doc/"), k.cast("string"), F.lit(".py"))).alias("diff_key"),
                    P.code_key("text").alias("code_key"), P.score_key("text").alias("score_key"), service.alias("service"), model.alias("model"),
                    P.format_description("text").alias("shown"), T.display_mdy(F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int"))).alias("day"))


_TAGGED = LONG + """, c as (select *, cast(regexp_extract(filename, 'brand_(\\d+)', 1) as int) as tag_id from changes_long),
ct as (select repo_owner, repo_name, commit_hash, filename, tag_id, cast(churn_count as double) / 7 as value from c where churn_count % 2 = 0)"""


def _brand_tags(ch):
    """Changes of an even churn as tag rows, with their brand's number as the tag."""
    tag = F.regexp_extract("filename", r"brand_(\d+)", 1).cast("int")
    return ch.filter(F.col("churn_count") % 2 == 0).select(*REPO, "commit_hash", "filename", tag.alias("tag_id"), (F.col("churn_count").cast("double") / 7).alias("value"))


@query("tag_totals_top", _TAGGED + f""", tot as (
  select repo_owner, repo_name, concat('brand ', tag_id) as name, cast(round(sum(cast(value as decimal(18,9))), 2) as decimal(18,2)) as total_value from ct group by 1, 2, 3),
ranked as (select *, row_number() over (partition by repo_owner, repo_name order by total_value desc, name) as rn,
  count(*) over (partition by repo_owner, repo_name) as k from tot)
select repo_owner, repo_name, case when k <= {G.TOP_TAGS} or rn <= {G.TOP_TAGS} then name else 'Other' end as name, cast(sum(total_value) as decimal(18,2)) as total_value
from ranked group by 1, 2, 3""")
def q_tag_totals_top(spark, sf):
    # A8 with its own eleven: 25 tags, the rest folded
    ct = _brand_tags(X.changes_long(spark, sf))
    tags = ct.select(*REPO, "tag_id").distinct().withColumn("name", F.concat(F.lit("brand "), F.col("tag_id").cast("string")))
    return G.tag_totals(ct, tags, include_all=False)


@query("untagged_code_changes", _TAGGED + """, n as (
  select *, case when churn_count % 7 = 0 then replace(filename, '.py', '.md') else filename end as name from c)
select n.repo_owner, n.repo_name, n.commit_hash, n.name as filename from n
anti join ct on n.repo_owner = ct.repo_owner and n.repo_name = ct.repo_name and n.commit_hash = ct.commit_hash and n.name = ct.filename
where trim(coalesce(description, '')) <> '' and not n.name like '%.md'""")
def q_untagged_code_changes(spark, sf):
    # A part of the changes is tagged, and a part is no code
    ch = X.changes_long(spark, sf)
    ct = _brand_tags(ch)
    renamed = ch.withColumn("filename", F.when(F.col("churn_count") % 7 == 0, F.replace("filename", F.lit(".py"), F.lit(".md"))).otherwise(F.col("filename")))
    return G.untagged(renamed, ct, ["commit_hash", "filename"]).select(*REPO, "commit_hash", "filename")


_CATALOGUE = {
    "tag_rows": "from ctags where tag_id = 1", "files_changed_since": "from changes_long where committed_at > timestamp '2001-06-01'", "churn_above": "from changes_long where churn_count > 60",
    "tag_names": "from tags_dim", "tag_id": "from tags_dim where name = 'click'", "open_pulls": "from pulls where state = 'open'",
    "merged_since": "from pulls where merged and merged_at >= timestamp '2001-05-01'", "pulls_by_user": "from pulls where user_login = 'Customer#000000007'",
    "pulls_titled": "from pulls where title like '%URGENT%'",
}


@query("catalogue_counts", X.sql_with(X.SQL_CHANGES_LONG, X.SQL_PULL_REQUESTS, X.SQL_COMMIT_TAGS) + """, author as (select min(author) as a from changes_long)
""" + "\nunion all ".join(f"select repo_owner, repo_name, '{name}' as query, count(*) as n {sql} group by 1, 2" for name, sql in _CATALOGUE.items())
       + """
union all select repo_owner, repo_name, 'changes_by_author', count(*) from changes_long, author where changes_long.author = author.a group by 1, 2
union all select repo_owner, repo_name, 'top_tag_changes', least(count(*), 10) from ctags where tag_id = 2 group by 1, 2
union all select repo_owner, repo_name, 'merge_hours', cast(1 as bigint) from pulls where merged group by 1, 2""")
def q_catalogue_counts(spark, sf):
    # K1-K12 through the catalogue itself, the rows that each gives per
    # repository
    from ..operators.catalogue import catalogue
    ch, prs = X.changes_long(spark, sf), X.pull_requests(spark, sf)
    ct, tags = X.event_commit_tags(spark, sf), X.event_tags(spark, sf)
    author = ch.agg(F.min("author")).first()[0]
    found = {
        "tag_rows": catalogue("tag_rows", ct, tag_id=1), "top_tag_changes": catalogue("top_tag_changes", ct, tag_id=2, key=["id"]),
        "changes_by_author": catalogue("changes_by_author", ch, author=author),
        "files_changed_since": catalogue("files_changed_since", ch, as_of="2001-07-01"), "churn_above": catalogue("churn_above", ch, x=60),
        "tag_names": catalogue("tag_names", tags), "tag_id": catalogue("tag_id", tags, name="click"), "open_pulls": catalogue("open_pulls", prs),
        "merged_since": catalogue("merged_since", prs, as_of="2001-08-01", months=3), "pulls_by_user": catalogue("pulls_by_user", prs, user="Customer#000000007"),
        "pulls_titled": catalogue("pulls_titled", prs, word="URGENT"), "merge_hours": catalogue("merge_hours", prs),
    }
    out = None
    for name, rows in found.items():
        part = rows.groupBy(*REPO).agg(F.count(F.lit(1)).alias("n")).select(*REPO, F.lit(name).alias("query"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("cost_log_appended", f"""with c as (select role, cast(ceil(length(text) / 4.0) as bigint) as tokens from conversations)
select cast(sum(case when role = 'assistant' then tokens * 0.0000006 else tokens * 0.00000015 end) as decimal(30,10)) as cost_to_date,
  cast(sum(case when role = 'assistant' then 0 else tokens end) as bigint) as input, cast(sum(case when role = 'assistant' then tokens else 0 end) as bigint) as output
from c""")
def q_cost_log_appended(spark, sf):
    # Every message of both roles is a line of the cost log, written
    # in two appends
    price = PRICES[DEFAULT_SERVICE][DEFAULT_MODEL]
    path = _tmp(spark, "costlog")
    m = X.read_table(spark, sf, "conversations").select("conv_id", "role", L.estimate_tokens("text").alias("t"))
    out = F.col("role") == "assistant"
    zero = F.lit(0).cast("bigint")
    rows = m.select("conv_id", F.lit("2024-01-01").alias("date"), F.lit(f"{DEFAULT_SERVICE}-{DEFAULT_MODEL}").alias("model"),
                    F.when(out, zero).otherwise(F.col("t")).alias("input"), F.when(out, F.col("t")).otherwise(zero).alias("output"))
    cost = (F.col("input") * price["input"] + F.col("output") * price["output"]) / 1_000_000
    for half in (0, 1):
        LG.append_costs(rows.filter(F.col("conv_id") % 2 == half).withColumn("cost", cost), path)
    log = LG.read_cost_log(spark, path)
    spent = LG.cost_to_date(log).select(F.col("cost_to_date").cast("decimal(30,10)").alias("cost_to_date"))
    tokens = log.agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    return spent.unionByName(tokens, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("cost_to_date", "input", "output")])
