"""Source trees, ignore patterns, repo maps and retrieval tables
(S8, S9, S10, S14)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import REPO
from ..schemas import REPO_MAP
from .commit_log import with_repo

# Extensions the code parser reads.
CODE_EXTENSIONS = [".py", ".js", ".java", ".rb"]


# Longer files are rejected by their length; their bytes are never read.
MAX_FILE_BYTES = 64 << 20

_LAYOUT = r"/repo_owner=([^/]+)/repo_name=([^/]+)/(.+)$"
_RAW = "path string, length bigint, content binary"


def _decoded(part: Column) -> Column:
    """A folder value as it was written: Spark escapes some characters as %XX."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _wanted(exts: list[str] | None):
    return lambda name: exts is None or name.endswith(tuple(exts))


def _hidden_files(spark: SparkSession, root: str, exts: list[str] | None, max_bytes: int) -> DataFrame:
    """(path, length, content) of the files that Spark's file index passes over: a component of their path below ``root``
    begins with ``_`` or ``.`` (``__init__.py``, ``.gitignore``).  ``.git`` folders are left out.  Repositories are listed
    and read by tasks, with the file systems that Arrow knows (local, HDFS, S3, GCS)."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/repo_owner=*/repo_name=*")) or []
    folders = [str(x.getPath().toUri()) for x in found] or [str(fs.makeQualified(top).toUri())]
    wanted = _wanted(exts)

    def read(batches):
        from pyarrow import fs as afs
        for batch in batches:
            for folder in batch["folder"]:
                files, base = afs.FileSystem.from_uri(folder)
                rows = []
                for info in files.get_file_info(afs.FileSelector(base, recursive=True)):
                    parts = info.path[len(base):].strip("/").split("/")
                    if info.size and ".git" not in parts and wanted(parts[-1]) and any(
                            x[0] == "." or (x[0] == "_" and "=" not in x) for x in parts):
                        content = None
                        if info.size <= max_bytes:
                            with files.open_input_stream(info.path) as f:
                                content = f.read()
                        rows.append((info.path, info.size, content))
                        if len(rows) == 64:
                            yield pd.DataFrame(rows, columns=["path", "length", "content"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "length", "content"])

    spread = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(max(1, len(folders)), "folder")
    return spread.mapInPandas(read, _RAW)


def read_source_tree(spark: SparkSession, root: str, exts: list[str] | None = CODE_EXTENSIONS, repo_owner: str | None = None,
                     repo_name: str | None = None, max_bytes: int = MAX_FILE_BYTES, hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """Source trees -> (files, rejects) (S8).  ``exts=None`` reads every file (the first retrieval index does).

    files: repo, file_path, content.  Without a given repository it comes from the layout
    ``<root>/repo_owner=<o>/repo_name=<n>/<path>``, and file_path is the path inside the repository; with a given one it is
    the whole path.  rejects: repo, file_path, length, reason (not UTF-8, or longer than ``max_bytes``).

    File names are matched before any byte is read, and the content column of files that are too long is not read.  Spark's
    file index passes over empty files, which have no row, and over names that begin with ``_`` or ``.``; ``hidden=True``
    reads the latter too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if exts is not None:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(exts) + "}")
    raw = reader.load(root).select("path", "length", "content")
    # Two filters that the scan applies before it opens a file.
    short, long = raw.filter(F.col("length") <= max_bytes), raw.filter(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    rows = short.unionByName(long)
    if hidden:
        rows = rows.unionByName(_hidden_files(spark, root, exts, max_bytes))
    path = F.regexp_replace("path", "^file:", "")
    if repo_owner is None and repo_name is None:
        part = lambda i: F.regexp_extract("path", _LAYOUT, i)
        rows = rows.select(_decoded(part(1)).alias("repo_owner"), _decoded(part(2)).alias("repo_name"), part(3).alias("file_path"), "length", "content")
        rows = rows.filter(F.col("file_path") != "")
    else:
        rows = with_repo(rows, repo_owner, repo_name).select(*REPO, path.alias("file_path"), "length", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = rows.select(*REPO, "file_path", text.alias("content")).filter("content is not null")
    reason = F.when(F.col("length") > max_bytes, "too long").otherwise("not UTF-8")
    rejects = rows.filter(text.isNull()).select(*REPO, "file_path", "length", reason.alias("reason"))
    return files, rejects


def read_source_files(spark: SparkSession, root: str, exts: list[str] | None = CODE_EXTENSIONS,
                      repo_owner: str | None = None, repo_name: str | None = None) -> DataFrame:
    """The files of ``read_source_tree``."""
    return read_source_tree(spark, root, exts, repo_owner, repo_name)[0]


def gitignore_regex(pattern: str) -> tuple[str, bool] | None:
    """One ignore-file line -> (regex on the relative path, negated) or None
    for blanks and comments.  Git wildcard rules: ``*`` and ``?`` stay inside
    one path component, ``**`` spans components, a leading or inner ``/``
    anchors at the root, a trailing ``/`` matches directories only, and a
    match on a directory covers everything below it."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    neg = p.startswith("!")
    if neg:
        p = p[1:]
    if p.startswith("\\"):
        p = p[1:]
    dir_only = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out.append("/.*")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            j = p.find("]", i + 1)
            if j < 0:
                out.append(re.escape(c))
                i += 1
            else:
                body = p[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body + "]")
                i = j + 1
        else:
            out.append(re.escape(c))
            i += 1
    core = "".join(out)
    prefix = "^" if anchored else "^(?:.*/)?"
    suffix = "/.*$" if dir_only else "(?:/.*)?$"
    return prefix + core + suffix, neg


def filter_ignored(files: DataFrame, patterns: list[str], path: str = "rel_path") -> DataFrame:
    """Drop files whose relative path is ignored (S9): patterns are
    translated once on the driver; the last matching pattern decides
    (``!`` re-includes); ``.git`` is always ignored."""
    rules = [r for r in (gitignore_regex(p) for p in list(patterns) + [".git"]) if r]
    ignored: Column = F.lit(False)
    for rx, neg in rules:
        ignored = F.when(F.col(path).rlike(rx), F.lit(not neg)).otherwise(ignored)
    return files.filter(~ignored)


def ignore_lines(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """Lines of the ignore files among ``files`` (repo, file_path, content): repo, folder, line_no, line.  The folder is the
    one that holds the file, ``""`` for the root."""
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    own = files.filter((F.col("file_path") == name) | F.col("file_path").endswith("/" + name))
    return own.select(*REPO, folder.alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))


def ignore_rules(lines: DataFrame) -> DataFrame:
    """Ignore lines (repo, folder, line_no, line) of any number of repositories as rules: repo, folder, line_no, regex on the
    path below the folder, negated (S9).  Blanks and comments are no rules."""
    def translate(batches):
        for pdf in batches:
            found = [gitignore_regex(x or "") for x in pdf["line"]]
            pdf = pdf.assign(regex=[r[0] if r else None for r in found], negated=[bool(r and r[1]) for r in found])
            yield pdf[pdf["regex"].notna()][[*REPO, "folder", "line_no", "regex", "negated"]]
    return lines.select(*REPO, "folder", F.col("line_no").cast("int").alias("line_no"), "line").mapInPandas(
        translate, "repo_owner string, repo_name string, folder string, line_no int, regex string, negated boolean")


def filter_by_rules(files: DataFrame, rules: DataFrame, path: str = "file_path") -> DataFrame:
    """Drop the files that their own repository's rules ignore (S9); ``.git`` is always ignored.

    Rules of deeper folders come after those of the folders above them, and the last rule that matches decides.  A
    repository's rules are one row, as bounded as its ignore files; they are joined once, and files are neither exploded
    nor grouped."""
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    below = F.when(F.col("folder") == "", "").otherwise(F.concat("folder", F.lit("/")))
    per_repo = (rules.groupBy(*REPO).agg(F.array_sort(F.collect_list(F.struct(
        depth.alias("depth"), "line_no", below.alias("below"), "regex", "negated"))).alias("_rules")))
    p = F.col(path)
    hit = lambda r: F.startswith(p, r["below"]) & F.rlike(F.substr(p, F.length(r["below"]) + 1), r["regex"])
    ignored = F.aggregate("_rules", F.lit(False), lambda so_far, r: F.when(hit(r), ~r["negated"]).otherwise(so_far))
    kept = files.filter(~p.rlike(r"(^|/)\.git(/|$)")).join(per_repo, list(REPO), "left")
    return kept.filter(~F.coalesce(ignored, F.lit(False))).select(*files.columns)


def write_repo_map(functions: DataFrame, top_level: DataFrame, path: str) -> None:
    """Repo map (S10): one JSON document per file with its top-level part and
    its definitions (a file's list is bounded by its definitions)."""
    fn_cols = [c for c in functions.columns if c not in (*REPO, "file_path")]
    per_file = (functions.groupBy(*REPO, "file_path")
                .agg(F.collect_list(F.struct(*fn_cols)).alias("functions")))
    doc = top_level.join(per_file, [*REPO, "file_path"], "left")
    doc.write.mode("overwrite").partitionBy(*REPO).json(path)


def read_repo_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a repo map with their fixed nested schema, in one pass: repo, file_path, file_extension, imports,
    code, functions, ``_corrupt_record`` (the text of a line that is no such document, else NULL).

    Every line is parsed by the whole schema, whichever columns are read: a line is corrupt for all readers or for none."""
    lines = spark.read.schema("value string, repo_owner string, repo_name string").text(path).filter(F.trim("value") != "")
    doc = F.from_json("value", REPO_MAP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(*REPO, doc.alias("d")).select(*REPO, "d.*")


def read_repo_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Repo map -> (functions, top_level) flat tables (S10); corrupt lines are in neither (``repo_map_rejects``)."""
    doc = read_repo_documents(spark, path).filter("_corrupt_record is null")
    top = doc.select(*REPO, "file_path", "file_extension", "imports", "code")
    fns = doc.select(*REPO, "file_path", F.explode("functions").alias("f")).select(
        *REPO, "file_path", "f.*")
    return fns, top


def repo_map_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a repo map that are no document: repo, text."""
    bad = read_repo_documents(spark, path).filter("_corrupt_record is not null")
    return bad.select(*REPO, F.col("_corrupt_record").alias("text"))


def write_index(chunks: DataFrame, path: str) -> None:
    """Retrieval tables (S14): chunks (and vectors) partitioned by index."""
    chunks.write.mode("overwrite").partitionBy("index_name").parquet(path)


def read_index(spark: SparkSession, path: str, index_name: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if index_name is None else df.filter(F.col("index_name") == index_name)
