"""Fixed schemas of the tables the operators read and write (no inference).

Every table and column carries its meaning: a column's in the metadata of its
``StructField``, a table's in ``TABLES``.  ``describe`` and the catalogue (R9)
read them from here and nowhere else.
"""

from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
TS = T.TimestampNTZType()


# Meaning of the columns; a column that several tables have means the same in all of them.
MEANING = {
    "repo_owner": "account that owns the repository", "repo_name": "name of the repository",
    "commit_hash": "hash of the commit", "epoch": "time of the commit in seconds since 1970 (UTC)",
    "committed_at": "author's wall time of the commit, without its UTC offset", "author": "name of the author",
    "email": "mail address of the author", "filename": "path of the changed file in the repository",
    "churn_count": "lines added plus lines deleted", "description": "generated or given text about the change or pull request",
    "kind": "what was rejected: a whole record or one file line", "text": "the text itself",
    "number": "number of the pull request in its repository", "title": "title of the pull request", "user_login": "account that opened it",
    "state": "open or closed", "created_at": "time of creation", "merged": "whether it was merged", "merged_at": "time of the merge",
    "merge_commit_sha": "hash of the merge commit", "mergeable": "whether it could be merged when it was read",
    "mergeable_state": "why it could or could not", "comments": "number of comments", "review_comments": "number of review comments",
    "closed_at": "time when it was closed", "html_url": "address of its page",
    "tag_id": "number of the tag in its repository", "name": "name of the tag, data set or definition", "tag": "name of the tag",
    "value": "share of the change's work, or the value of a log entry", "hash": "key of the data's content", "summary": "generated paragraph",
    "ai_service": "service that wrote it", "ai_model": "model that wrote it", "start_date": "first commit of the data", "end_date": "last commit of the data",
    "line": "line, from 0", "character": "column, from 0", "start": "first position", "end": "position after the last",
    "file_path": "path of the file", "type": "function or class", "code": "source text", "lines_of_code": "lines of the definition",
    "cyclomatic_complexity": "independent paths through it", "nesting_depth": "deepest nesting of its syntax tree", "control_depth": "deepest nesting of control statements",
    "number_of_variables": "distinct names assigned", "number_of_function_calls": "calls in it", "calls": "names that are called", "imports": "imported modules",
    "docstring": "its documentation string", "location": "where it stands in the file", "file_extension": "extension of the file",
    "functions": "definitions of the file", "_corrupt_record": "line that is no document", "date": "day of the call", "model": "service and model",
    "input": "tokens sent", "output": "tokens received", "cost": "price in USD", "key": "name of the log entry", "logged_at": "time of the log record",
    "source_file": "file that was read", "position": "order in that file", "index_name": "retrieval index", "doc_id": "document of the chunk",
    "chunk_no": "number of the chunk in its document, from 0", "metadata": "origin of the chunk",
}


def _f(name, t, nullable=True):
    return T.StructField(name, t, nullable, {"meaning": MEANING[name]})


REPO_FIELDS = [_f("repo_owner", S, False), _f("repo_name", S, False)]

# One row per commit x file ("commits" table of the source application).
# committed_at is the author's wall time with the UTC offset removed;
# epoch is the instant in seconds (both kept, as in the source data).
CHANGES = T.StructType(REPO_FIELDS + [
    _f("commit_hash", S, False), _f("epoch", D), _f("committed_at", TS),
    _f("author", S), _f("email", S), _f("filename", S, False),
    _f("churn_count", L), _f("description", S),
])

# Rejected commit-log input (records and file lines that break the grammar).
REJECTS = T.StructType(REPO_FIELDS + [
    _f("kind", S), _f("commit_hash", S), _f("text", S),
])

PULL_REQUESTS = T.StructType(REPO_FIELDS + [
    _f("number", L), _f("title", S), _f("user_login", S), _f("state", S),
    _f("created_at", TS), _f("merged", T.BooleanType()), _f("merged_at", TS),
    _f("merge_commit_sha", S), _f("mergeable", S), _f("mergeable_state", S),
    _f("comments", I), _f("review_comments", I), _f("closed_at", TS),
    _f("html_url", S), _f("description", S),
])

# Column order of the pull-request dump (15 names in the header; rows carry
# the first 14 values, so description is NULL on read).
PR_DUMP_COLUMNS = [
    "number", "title", "user_login", "state", "created_at", "merged",
    "merged_at", "merge_commit_sha", "mergeable", "mergeable_state",
    "comments", "review_comments", "closed_at", "html_url", "description",
]

TAGS = T.StructType(REPO_FIELDS + [_f("tag_id", I, False), _f("name", S, False)])

COMMIT_TAGS = T.StructType(REPO_FIELDS + [
    _f("commit_hash", S, False), _f("filename", S, False),
    _f("tag", S, False), _f("value", D),
])

SUMMARIES = T.StructType(REPO_FIELDS + [
    _f("name", S), _f("hash", S), _f("summary", S), _f("ai_service", S),
    _f("ai_model", S), _f("start_date", TS), _f("end_date", TS),
    _f("created_at", TS),
])

POSITION = T.StructType([_f("line", I), _f("character", I)])
LOCATION = T.StructType([_f("start", POSITION), _f("end", POSITION)])

# One row per definition (function or class) found in a source file.
FUNCTIONS = T.StructType(REPO_FIELDS + [
    _f("file_path", S), _f("type", S), _f("name", S), _f("code", S),
    _f("lines_of_code", I), _f("cyclomatic_complexity", I),
    _f("nesting_depth", I), _f("control_depth", I),
    _f("number_of_variables", I), _f("number_of_function_calls", I),
    _f("calls", T.ArrayType(S)), _f("imports", T.ArrayType(S)),
    _f("docstring", S), _f("comments", T.ArrayType(S)),
    _f("location", LOCATION),
])

# One row per file: statements outside definitions.
TOP_LEVEL = T.StructType(REPO_FIELDS + [
    _f("file_path", S), _f("file_extension", S),
    _f("imports", T.ArrayType(S)), _f("code", T.ArrayType(S)),
])

# One JSON document of a repo map, a file; the repository is in the folders.
REPO_MAP = T.StructType([
    _f("file_path", S), _f("file_extension", S),
    _f("imports", T.ArrayType(S)), _f("code", T.ArrayType(S)),
    _f("functions", T.ArrayType(T.StructType(
        [f for f in FUNCTIONS.fields if f.name not in ("repo_owner", "repo_name", "file_path")]))),
    _f("_corrupt_record", S),
])

COST_LOG = T.StructType([
    _f("date", S), _f("model", S), _f("input", L), _f("output", L), _f("cost", D),
])

RUN_LOG = T.StructType([
    _f("repo_owner", S), _f("repo_name", S), _f("key", S), _f("value", S),
])

DESCRIPTION_LOG = T.StructType([
    _f("logged_at", TS), _f("filename", S), _f("commit_hash", S),
    _f("text", S), _f("source_file", S), _f("position", L),
])

CHUNKS = T.StructType([
    _f("index_name", S), _f("doc_id", S), _f("chunk_no", I), _f("text", S),
    _f("metadata", T.MapType(S, S)),
])

# Meaning of the tables: those of the database, and those of files.
TABLES = {
    "changes": (CHANGES, "One row per commit and file: who changed what, when, how much, and the "
                         "generated description of the change."),
    "tags": (TAGS, "Work-type tags of a repository."),
    "commit_tags": (COMMIT_TAGS, "Share of a change's work per tag; shares of one change sum to 1."),
    "pull_requests": (PULL_REQUESTS, "Pull requests with state, times, merge commit and description."),
    "summaries": (SUMMARIES, "Generated paragraphs per data set with the data's content key."),
}
FILES = {
    "rejects": (REJECTS, "Commit-log input that breaks the grammar."),
    "functions": (FUNCTIONS, "Definitions found in source files, with their metrics."),
    "top_level": (TOP_LEVEL, "Statements and imports of a file outside of its definitions."),
    "cost_log": (COST_LOG, "One row per model call with its tokens and price."),
    "run_log": (RUN_LOG, "What a run has finished, and when."),
    "description_log": (DESCRIPTION_LOG, "Descriptions in the order in which they were written."),
    "chunks": (CHUNKS, "Texts of the retrieval indexes."),
}
