"""Source trees of many repositories: layout, rejects, hidden names, ignore rules as data, repo maps."""

import gzip
import os

from pyspark.sql import functions as F

from repolens.sources import source_files as SF


def tree(root, files):
    for rel, data in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


TREE = {
    "repo_owner=o/repo_name=007/src/a.py": "x = 'é'\n", "repo_owner=o/repo_name=007/src/a b+%41.py": "1", "repo_owner=o/repo_name=007/src/empty.py": "", "repo_owner=o/repo_name=007/empty/__init__.py": "", "repo_owner=o/repo_name=007/logo.png": b"\x89PNG\xff",
    "repo_owner=o/repo_name=x%3Ay/web/app.js": "f()", "repo_owner=o/repo_name=x%3Ay/notes.txt": "n\n" * 50, "repo_owner=o/repo_name=x%3Ay/bad.py": gzip.compress(b"a"),
    "repo_owner=o/repo_name=007/pkg/__init__.py": "VERSION = 1", "repo_owner=o/repo_name=007/.gitignore": "build/\n!keep\n", "repo_owner=o/repo_name=007/.git/HEAD.py": "no",
    "repo_owner=o/repo_name=007/_gen/z.py": "z", "stray.py": "outside of every repository",
}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tree_of_many_repositories(spark, tmp):
    tree(tmp, TREE)
    files, rejects = SF.read_source_tree(spark, tmp, exts=None, max_bytes=60)
    assert rows(files, "repo_name", "file_path", "content") == [("007", "src/a b+%41.py", "1"), ("007", "src/a.py", "x = 'é'\n"), ("x:y", "web/app.js", "f()")]
    assert rows(rejects, "repo_name", "file_path", "reason") == [("007", "logo.png", "not UTF-8"), ("x:y", "bad.py", "not UTF-8"), ("x:y", "notes.txt", "too long")]
    files, rejects = SF.read_source_tree(spark, tmp)
    assert rows(files, "file_path") == [("src/a b+%41.py",), ("src/a.py",), ("web/app.js",)]
    assert rows(rejects, "file_path") == [("bad.py",)]
    files, _ = SF.read_source_tree(spark, tmp, hidden=True)
    assert rows(files, "file_path") == [("_gen/z.py",), ("pkg/__init__.py",), ("src/a b+%41.py",), ("src/a.py",), ("web/app.js",)]
    lines = SF.ignore_lines(SF.read_source_tree(spark, tmp, exts=[".gitignore"], hidden=True)[0])
    assert rows(lines, "repo_name", "folder", "line_no", "line") == [("007", "", 0, "build/"), ("007", "", 1, "!keep"), ("007", "", 2, "")]


def test_names_and_lengths_are_filtered_before_reading(spark, tmp):
    tree(tmp, TREE)
    files, rejects = SF.read_source_tree(spark, tmp, max_bytes=60)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,60)" in text(files) and text(files).count("FileScan binaryFile") == 1
    # The files that are too long are a scan of their own, without the content column.
    long = [x for x in text(rejects).splitlines() if "GreaterThan(length,60)" in x]
    assert len(long) == 1 and "content" not in long[0].split("ReadSchema")[1]


def test_rules_of_several_repositories_and_folders(spark):
    lines = [("o", "r", "", 0, "*.log"), ("o", "r", "", 1, "build/"), ("o", "r", "sub", 0, "!keep.log"), ("o", "r", "sub", 1, "/top.txt"),
             ("o", "r", "sub/deep", 0, "*.log"), ("o", "s", "", 0, "# nothing"), ("o", "s", "", 1, "a?.txt")]
    rules = SF.ignore_rules(spark.createDataFrame(lines, "repo_owner string, repo_name string, folder string, line_no int, line string"))
    assert rules.count() == 6
    files = [("r", "a.log"), ("r", "x/build/y"), ("r", "sub/keep.log"), ("r", "sub/deep/keep.log"), ("r", "sub/other.log"), ("r", "sub/top.txt"), ("r", "sub/x/top.txt"),
             ("r", "subkeep.log"), ("r", ".git/config"), ("r", "a1.txt"), ("s", "a.log"), ("s", "a1.txt"), ("t", "a.log"), ("t", "x/.git/y"), ("t", ".github/y")]
    df = spark.createDataFrame([("o", *f, 1) for f in files], "repo_owner string, repo_name string, file_path string, extra int")
    kept = SF.filter_by_rules(df, rules)
    assert kept.columns == df.columns
    assert rows(kept, "repo_name", "file_path") == [("r", "a1.txt"), ("r", "sub/keep.log"), ("r", "sub/x/top.txt"), ("s", "a.log"), ("t", ".github/y"), ("t", "a.log")]
    assert rows(SF.filter_by_rules(df, rules.filter("false")), "file_path") == rows(df.filter(~F.col("file_path").rlike(r"(^|/)\.git/")), "file_path")


def test_repo_map_lines_that_are_no_documents(spark, tmp):
    good = '{"file_path": "a.py", "imports": ["x"], "functions": [{"name": "f", "lines_of_code": 3}], "new_field": 1}'
    tree(tmp, {"m/repo_owner=o/repo_name=007/part-0.json": good + "\n\n" + '{"file_path": "b.py", "functions": [{"na\n{"file_path": "c.py", "functions": 5}\n'})
    path = os.path.join(tmp, "m")
    fns, top = SF.read_repo_map(spark, path)
    assert rows(fns, "repo_name", "file_path", "name", "lines_of_code", "docstring") == [("007", "a.py", "f", 3, None)]
    assert rows(top, "file_path", "imports") == [("a.py", ["x"])]
    assert [t[1][:20] for t in rows(SF.repo_map_rejects(spark, path), "repo_name", "text")] == ['{"file_path": "b.py"', '{"file_path": "c.py"']
