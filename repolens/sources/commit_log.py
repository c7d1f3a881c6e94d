"""Commit log and cleaned-changes files.

Log grammar: records start with ``^^``; the first line is
``hash--epoch--iso time--author--email--message`` (at least 5 ``--`` parts);
the other lines are ``additions<TAB>deletions<TAB>path``.  Reading splits the
file at ``^^`` with the text source's ``lineSep`` (splittable: large logs are
read by many tasks).  Malformed records and lines go to a rejects DataFrame.

Repository keys come from the directory layout
``.../repo_owner=<o>/repo_name=<n>/<file>`` (partition discovery), or from
arguments for a single repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import REPO
from ..functions.text import (clean_message, exclude, parse_churn, strip_offset,
                              unknown_author)
from ..schemas import CHANGES, REJECTS

# Fixed values of the log grammar.
RECORD_SEP = "^^"
FIELD_SEP = "--"
MIN_HEADER_FIELDS = 5
MIN_FILE_FIELDS = 3


def _strip(c):
    # Python str.strip(): whitespace at both ends; the pattern, which is slow,
    # only where its $ stands before one of the other line ends
    other_end = c.endswith("\u0085") | c.endswith("\u2028") | c.endswith("\u2029")
    return F.when(other_end, F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(" \t\n\x0b\f\r")))


def read_log_records(spark: SparkSession, path: str, repo_owner: str | None = None,
                     repo_name: str | None = None) -> DataFrame:
    """Raw records (text between ``^^`` markers) with repository and position."""
    raw = text_reader(spark.read, repo_owner, repo_name).option("lineSep", RECORD_SEP).text(path)
    return with_repo(raw, repo_owner, repo_name).select(
        *REPO, F.input_file_name().alias("source_file"),
        F.monotonically_increasing_id().alias("record_pos"), "value")


def folder_keys(repo_owner: str | None = None, repo_name: str | None = None) -> list[str]:
    """DDL of the repository keys that come from the folders.  They stay text:
    a repository ``007`` is not the number 7."""
    return [f"{c} string" for c, given in zip(REPO, (repo_owner, repo_name)) if given is None]


def text_reader(reader, repo_owner: str | None = None, repo_name: str | None = None):
    """The reader (batch or stream) of text files whose folders name the repository."""
    keys = folder_keys(repo_owner, repo_name)
    return reader.schema(", ".join(["value string", *keys])) if keys else reader


def with_repo(df: DataFrame, repo_owner: str | None, repo_name: str | None) -> DataFrame:
    if repo_owner is not None:
        df = df.withColumn("repo_owner", F.lit(repo_owner))
    if repo_name is not None:
        df = df.withColumn("repo_name", F.lit(repo_name))
    missing = [c for c in REPO if c not in df.columns]
    if missing:
        raise ValueError(f"repository key {missing} neither in the path layout nor given")
    return df


def parse_commit_lines(records: DataFrame, exclude_files: str = "",
                       exclude_authors: str = "") -> DataFrame:
    """Records (repo, source_file, record_pos, value) -> one row per file
    line, and per record or line that breaks the grammar, in one pass.

    Columns: those of ``changes``, then ``source_file, record_pos, line_no``
    (the input order that insert-if-absent needs), ``kind`` (NULL for a good
    line, else 'record' or 'line') and ``text`` of what was rejected.
    """
    r = (records.withColumn("_rec", _strip(F.col("value"))).filter(F.col("_rec") != "")
         .withColumn("_lines", F.split("_rec", "\n"))
         .withColumn("_info", F.split(F.element_at("_lines", 1), FIELD_SEP)))
    when = strip_offset(F.get("_info", F.lit(2))).try_cast("timestamp_ntz")
    # a bad time is a reject, too
    ok = F.coalesce((F.size("_info") >= MIN_HEADER_FIELDS) & when.isNotNull(), F.lit(False))
    field = lambda i: F.when(F.col("_ok"), F.get("_info", F.lit(i)))
    files = F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))
    head = r.withColumn("_ok", ok).select(
        *REPO, "source_file", "record_pos", "_ok",
        field(0).alias("commit_hash"), field(1).try_cast("double").alias("epoch"),
        F.when(F.col("_ok"), when).alias("committed_at"),
        F.when(F.col("_ok"), unknown_author(F.get("_info", F.lit(3)))).alias("author"), field(4).alias("email"),
        F.when(F.col("_ok"), files).otherwise(F.array("_rec")).alias("_files"))
    head = head.filter(~F.col("_ok") | exclude("author", exclude_authors))
    # the outer form: for the other one Spark puts a filter on the array's size
    # below, which splits every record many times over
    lines = (head.select(*[c for c in head.columns if c != "_files"], F.posexplode_outer("_files").alias("line_no", "_line"))
             .filter(~F.col("_ok") | (F.col("_line") != "")).withColumn("_f", F.split("_line", "\t")))
    kind = F.when(~F.col("_ok"), "record").when(F.size("_f") < MIN_FILE_FIELDS, "line")
    lines = lines.withColumn("kind", kind).withColumn("filename", F.when(F.col("kind").isNull(), F.get("_f", F.lit(2))))
    lines = lines.filter(F.col("kind").isNotNull() | exclude("filename", exclude_files))
    churn = parse_churn(F.get("_f", F.lit(0))) + parse_churn(F.get("_f", F.lit(1)))
    made = {"churn_count": F.when(F.col("kind").isNull(), churn), "description": F.lit(None).cast("string")}
    return lines.select(*[made.get(f.name, F.col(f.name)).alias(f.name) for f in CHANGES.fields], "source_file", "record_pos", "line_no",
                        "kind", F.when(F.col("kind").isNotNull(), F.col("_line")).alias("text"))


def split_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed lines -> (changes with their input order, rejects)."""
    return (lines.filter("kind is null").drop("kind", "text"),
            lines.filter("kind is not null").select(*[f.name for f in REJECTS.fields]))


def parse_commit_records(records: DataFrame, exclude_files: str = "",
                         exclude_authors: str = "") -> tuple[DataFrame, DataFrame]:
    """Records (repo, source_file, record_pos, value) -> (changes, rejects)."""
    return split_rejects(parse_commit_lines(records, exclude_files, exclude_authors))


def read_commit_log(spark: SparkSession, path: str, repo_owner: str | None = None,
                    repo_name: str | None = None, exclude_files: str = "",
                    exclude_authors: str = "") -> tuple[DataFrame, DataFrame]:
    """Commit log file(s) -> (changes, rejects)."""
    return parse_commit_records(read_log_records(spark, path, repo_owner, repo_name),
                                exclude_files, exclude_authors)


def render_commit_log(changes: DataFrame, message: str = "message", by: tuple = (), keep: tuple = ()) -> DataFrame:
    """Inverse of S1: one text row per commit in the log grammar (used to
    write logs; a commit's row holds its own file lines only).  ``by``:
    columns that the commit determines; where ``changes`` is partitioned by
    them its lines are not shuffled again.  ``keep``: columns of the commit
    that stay beside the text."""
    ts = F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss")
    # both numbers of a line are in use: a third of the churn is deletions
    deleted = F.floor(F.col("churn_count") / 3)
    line = F.concat_ws("\t", (F.col("churn_count") - deleted).cast("string"), deleted.cast("string"), "filename")
    per = (changes.groupBy(*REPO, *by, "commit_hash", "epoch", "committed_at", "author", "email")
           .agg(F.array_sort(F.collect_list(F.struct("filename", line.alias("l")))).alias("_ls")))
    return per.select(*REPO, *keep, F.concat(
        F.lit(RECORD_SEP), F.concat_ws(FIELD_SEP, "commit_hash",
                                       F.coalesce(F.col("epoch").cast("string"), F.lit("0.0")),
                                       F.concat(ts, F.lit("+00:00")), "author",
                                       F.coalesce("email", F.lit("Unknown")),
                                       clean_message(F.lit(message))),
        F.lit("\n"), F.array_join(F.transform("_ls", lambda s: s["l"]), "\n"),
        F.lit("\n")).alias("value"))


def write_commit_log(changes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write logs, one folder per repository (``repo_owner=/repo_name=``)."""
    write_rendered(render_commit_log(changes), path, mode)


def write_rendered(log: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the rows of ``render_commit_log``."""
    log.select(*REPO, "value").write.mode(mode).partitionBy(*REPO).option("lineSep", "\n").text(path)


def write_changes(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cleaned changes (S2): parquet by default; CSV is quoted with a header
    (commas in names or paths stay intact, D6)."""
    out = df.select(*[f.name for f in CHANGES.fields])
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read cleaned changes with the fixed schema (S2), no inference."""
    if fmt == "csv":
        return (spark.read.schema(CHANGES).option("header", True).option("multiLine", True)
                .option("escape", '"').csv(path))
    return spark.read.schema(CHANGES).parquet(path)
