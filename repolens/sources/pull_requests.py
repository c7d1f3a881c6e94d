"""Pull-request dump (S3): tab-separated, header of 15 names, rows carry
the first 14 values (description is NULL), ``None`` means NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import REPO
from ..functions.text import clean_title, strip_offset
from ..schemas import PR_DUMP_COLUMNS, PULL_REQUESTS
from .commit_log import folder_keys, with_repo

def _ts(c):
    return strip_offset(F.col(c)).try_cast("timestamp_ntz")


def read_pull_requests(spark: SparkSession, path: str, repo_owner: str | None = None,
                       repo_name: str | None = None) -> DataFrame:
    schema = ", ".join([*(f"{c} string" for c in PR_DUMP_COLUMNS), *folder_keys(repo_owner, repo_name)])
    raw = (spark.read.schema(schema).option("sep", "\t").option("header", True)
           .option("nullValue", "None").option("quote", "").option("mode", "PERMISSIVE").csv(path))
    raw = with_repo(raw, repo_owner, repo_name)
    conv = {
        "number": F.col("number").cast("bigint"),
        "created_at": _ts("created_at"), "merged_at": _ts("merged_at"),
        "closed_at": _ts("closed_at"),
        "merged": F.lower("merged") == "true",
        "comments": F.col("comments").try_cast("int"),
        "review_comments": F.col("review_comments").try_cast("int"),
    }
    return raw.select(*[conv.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
                        for f in PULL_REQUESTS.fields])


def write_pull_requests(prs: DataFrame, path: str) -> None:
    """Write the dump format: every file starts with the header of 15 names,
    rows carry 14 values.

    Rows are range-partitioned by (repo, number), so a repository holding a
    third of all PRs is spread over many tasks; within a task a header line
    is inserted wherever a repository starts, so each file a task writes for
    a repository begins with the header (the reader takes the first line of
    every file as the header).
    """
    import pandas as pd

    # no cell may hold the separators: tabs and line ends become spaces
    vals = [F.coalesce(F.translate(F.col(c).cast("string"), "\t\r\n", "   "), F.lit("None")) for c in PR_DUMP_COLUMNS[:-1]]
    vals[1] = F.coalesce(clean_title(F.col("title")), F.lit("None"))
    vals[5] = F.when(F.col("merged"), F.lit("True")).otherwise(F.lit("False"))
    header = "\t".join(PR_DUMP_COLUMNS)
    n = max(prs.sparkSession.sparkContext.defaultParallelism, 1)
    body = (prs.select(*REPO, "number", F.concat_ws("\t", *vals).alias("value"))
            .repartitionByRange(n, *REPO, "number").sortWithinPartitions(*REPO, "number"))

    def with_headers(batches):
        last, seq = None, 0
        for pdf in batches:
            out = {"repo_owner": [], "repo_name": [], "value": [], "_seq": []}
            for o, r, v in zip(pdf["repo_owner"], pdf["repo_name"], pdf["value"]):
                if (o, r) != last:
                    out["repo_owner"].append(o); out["repo_name"].append(r)
                    out["value"].append(header); out["_seq"].append(seq)
                    seq += 1
                    last = (o, r)
                out["repo_owner"].append(o); out["repo_name"].append(r)
                out["value"].append(v); out["_seq"].append(seq)
                seq += 1
            yield pd.DataFrame(out)

    lines = body.mapInPandas(with_headers, "repo_owner string, repo_name string, value string, _seq long")
    # in-task order (repo, _seq) already starts with the partition columns,
    # so the writer keeps it
    (lines.sortWithinPartitions(*REPO, "_seq").drop("_seq")
     .write.mode("overwrite").partitionBy(*REPO).text(path))
