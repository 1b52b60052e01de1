"""Reports, scopes, messages, the graph cache and the command line, with values worked out by hand."""
import json

import pytest
from pyspark.sql import functions as F

from ripplescope import cli
from ripplescope.functions import numbers, paths
from ripplescope.operators import commits, graph, relevance, risk, scope, test_mapping
from ripplescope.plans import analyze, report
from ripplescope.sources import cache, config, diffs, project

CHANGE = "change_set_id string, ordinal int, file_path string, change_type string, added_lines long, removed_lines long, is_new_file boolean, is_deleted boolean, functions_modified array<string>"
SCOPE = "change_set_id string, description string, target_files array<string>, target_functions array<string>, target_concepts array<string>, confidence double, source string"
INPUT = "change_set_id string, prompt string, cli_scope string, head_message string, pending_message string"
DIFF = """diff --git a/src/auth/login.py b/src/auth/login.py
--- a/src/auth/login.py
+++ b/src/auth/login.py
@@ -1,2 +1,3 @@ def check(x):
-import os
+import sys
+from m import y
diff --git a/yarn.lock b/yarn.lock
--- a/yarn.lock
+++ b/yarn.lock
@@ -1 +1 @@
-a
+b
"""


def _changes(spark, *rows, key="c"):
    data = [(key, i, p, k, a, r, k == "added", k == "deleted", f) for i, (p, k, a, r, f) in enumerate(rows)]
    return spark.createDataFrame(data, CHANGE)


def test_centrality_is_held_against_the_change_set_alone(spark):
    edges = spark.createDataFrame([("x.py", "a.py"), *((f"y{i}.py", "hub.py") for i in range(4))], "src string, dst string")
    changes = _changes(spark, ("a.py", "modified", 1, 0, []), ("b.py", "modified", 1, 0, [])).unionByName(_changes(spark, ("b.py", "modified", 1, 0, []), key="none"))
    assert {r.change_set_id: r.centrality for r in risk.centrality_factor(changes, edges).collect()} == {"c": 0.5, "none": 0.0}


def test_path_match_takes_the_targets_own_stem_only(spark):
    rows = spark.createDataFrame([("src/auth/util.py", ["src/auth/login.py"], []), ("src/auth/login.js", ["src/auth/login.py"], []), ("src/auth/util.py", ["x.py"], ["AUTH"]), ("a.py", [], [])], "p string, t array<string>, c array<string>")
    none = F.array().cast("array<string>")
    found = [r[0] for r in rows.select(relevance.path_match(F.col("p"), F.col("t"), none, F.col("c"))).collect()]
    assert found == pytest.approx([0.0, 1 / 3, 1 / 3, 0.0])


def test_scopes(spark):
    inputs = spark.createDataFrame([("p", "fix a", "b", "c", ""), ("s", " ", "fix b", "c", ""), ("h", None, "", "fix c", ""), ("i", None, None, "", ""), ("n", None, None, "", "")], INPUT)
    changes = _changes(spark, ("x/h.c", "modified", 1, 0, ["f"]), ("x/The.c", "modified", 1, 0, []), ("the/y.c", "modified", 1, 0, []), key="i")
    rows = {r.change_set_id: r for r in analyze.scopes_of(inputs, changes, spark.createDataFrame([("docs/fix.md",), ("fix/one.py",), ("fix/two.md",)], "path string"), analyze.Config(areas={"h": {"files": ["more.py"]}})).collect()}
    assert {k: (r.source, r.confidence) for k, r in rows.items()} == {"p": ("prompt_file", 1.0), "s": ("cli", 0.8), "h": ("commit_message", 0.6), "i": ("inferred", 0.3), "n": ("inferred", 0.3)}
    assert rows["s"].target_files == ["docs/fix.md", "fix/one.py"]  # a stem of any kind of file, source files of a directory
    assert rows["i"].target_concepts == ["h", "the", "x", "y"] and rows["i"].target_files == ["more.py", "the/y.c", "x/The.c", "x/h.c"] and rows["i"].description == "Changes concentrated in x"
    assert rows["n"].description == "No changes to analyse" and rows["n"].target_files == []


def test_messages(spark):
    changes = _changes(spark, ("src/auth/login.py", "modified", 1, 1, []))
    messages = spark.createDataFrame([("c", "fix(auth): mend the login\n\nbody"), ("d", "update the things here"), ("e", "wip")], "change_set_id string, message string")
    rows = {r.change_set_id: r for r in commits.quality(messages, changes).collect()}
    assert (rows["c"].score, rows["c"].issues, rows["c"].is_vague) == (1.0, [], False)
    assert (rows["d"].score, rows["d"].suggested_improvement) == (0.9, None)  # no changes of its own: nothing to mention
    assert (rows["e"].score, len(rows["e"].issues)) == (0.4, 3)


def test_suggestion_fails_where_a_path_ends_first(spark):
    changes = _changes(spark, ("a/b", "modified", 1, 0, []), ("a/b/c.py", "modified", 1, 0, []))
    row = commits.quality(spark.createDataFrame([("c", "wip")], "change_set_id string, message string"), changes).first()
    assert row.score is None and row.suggested_improvement is None


def test_numbers(spark):
    values = [0.125, 0.375, 0.075, 0.005, 1.0, 0.0, 0.999, 2.675, 0.635, 0.285]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", numbers.fixed(F.col("x")), numbers.percent(F.col("x"))).collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [(v, f"{v:.2f}", f"{v:.0%}") for v in values]


def test_path_words(spark):
    row = spark.range(1).select(paths.module(F.lit("src/a.b/c.d.py")), paths.module(F.lit("x.py")), paths.plural(F.lit(1), "file"), paths.plural(F.lit(0), "file"), paths.plural(F.lit(2), "box", "boxes"), paths.shortened(F.lit("a" * 70), 10)).first()
    assert row[:] == ("src.a.b.c.d", "x", "file", "files", "boxes", "..." + "a" * 7)


def test_unbounded_distance(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n6", "n0")], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(7)] + [("z",)], "path string")
    pairs = spark.createDataFrame([("n0", "n6"), ("n6", "n5"), ("n0", "z"), ("q", "q"), ("q", "n0")], "src string, dst string")
    assert {(r.src, r.dst): r.distance for r in graph.distance(pairs, nodes, edges).collect()} == {("n0", "n6"): 6, ("n6", "n5"): 6, ("n0", "z"): -1, ("q", "q"): 0, ("q", "n0"): -1}


def test_function_matches(spark):
    changes = _changes(spark, ("a.py", "modified", 1, 0, ["run", "Box::open", "*go"]))
    tests = spark.createDataFrame([("tests/test_a.py", "def test_run(): pass"), ("tests/test_b.py", "def test_runner(): test_Box::open"), ("tests/test_c.py", "call(test_*go)")], "path string, source string")
    assert {(r.test_file, r.function) for r in test_mapping.by_function(changes, tests).collect()} == {("tests/test_a.py", "run"), ("tests/test_b.py", "Box::open"), ("tests/test_c.py", "*go")}


def _report(spark):
    changes = diffs.parse(spark.createDataFrame([("c", DIFF)], "change_set_id string, diff_text string"))
    files = spark.createDataFrame([(p,) for p in ("app.py", "src/auth/login.py", "tests/test_login.py", "web.py")], "path string")
    edges = spark.createDataFrame([("app.py", "src/auth/login.py"), ("web.py", "app.py")], "src string, dst string")
    inputs = spark.createDataFrame([("c", None, "fix src/auth/login.py", "", " wip \n")], INPUT)
    return analyze.analyze(changes, inputs, files, edges)


def test_whole_reports(spark):
    reports = _report(spark)
    data = json.loads(report.json(reports).first().json)
    assert list(data) == ["changed_files", "intended_scope", "phantom_changes", "downstream_impacts", "risk_score", "risk_level", "suggested_tests", "commit_message_quality"]
    first = data["changed_files"][0]
    assert list(first) == ["file_path", "change_type", "hunks", "added_lines", "removed_lines", "functions_modified", "imports_modified", "language", "is_new_file", "is_deleted", "old_path"]
    assert first["functions_modified"] == ["check"] and first["imports_modified"] == ["sys", "m.y", "os"] and first["language"] == "python" and first["old_path"] is None
    assert first["hunks"][0] == {"old_start": 1, "old_count": 2, "new_start": 1, "new_count": 3, "content": "\n-import os\n+import sys\n+from m import y\n", "function_header": "def check(x):"}
    assert data["commit_message_quality"]["message"] == "wip" and data["commit_message_quality"]["score"] == 0.2
    assert [(d["file_path"], d["distance"]) for d in data["downstream_impacts"]] == [("app.py", 1), ("web.py", 2)]
    log = json.loads(report.sarif(reports).first().sarif)["runs"][0]["results"]
    assert [r["ruleId"] for r in log] == ["DG001", "DG002", "DG002", "DG003", "DG004"]
    assert log[1]["message"]["text"] == "Downstream impact: 1-hop away, risk contribution: 0.80" and log[3]["message"]["text"] == "Overall regression risk: review (score: 0.43)" and log[4]["message"]["text"].startswith("Commit message quality: 20%. ")
    text = report.markdown(reports).first().markdown
    assert "### :memo: Commit Message Quality (20%)" in text and "- `app.py` (distance: 1, risk: 0.80, via: src/auth/login.py -> app.py)" in text


def test_terminal_report(spark):
    lines = report.terminal(_report(spark)).first().terminal.split("\n")
    assert all(len(x) == 60 for x in lines[:7]) and lines[1].strip("│ ") == "ripplescope blast radius" and lines[5].strip("│ ") == "Files changed: 2  |  Lines: +3 / -2"
    text = "\n".join(lines)
    assert 'Scope: "fix src/auth/login.py"' in text and "❌ Commit message quality: 20%\n   \"wip\"" in text
    assert "✅ In scope (1 file):\n   src/auth/login.py            +2 / -1   check" in text
    assert "⚠️  Phantom changes (1 file):\n   yarn.lock                   +1 / -1    [confidence: 10%]\n   │  → Dependency lockfiles auto-update when packages change" in text
    assert "   ├── app.py                       direct  via src/auth/login.py -> app.py\n   └── web.py                       2-hop" in text
    assert "🧪 Suggested tests to run:\n   pytest tests/test_login.py -v\n\n   tests/test_login.py              <- src/auth/login.py  (direct name match)" in text
    colored = report.terminal(_report(spark), color=True).first().terminal
    assert "\033[32m✅ In scope (1 file):\033[0m" in colored


def test_reports_of_tests(spark):
    changes = _changes(spark, ("a.py", "modified", 3, 1, []), ("b.py", "added", 1, 0, []))
    found = test_mapping.suggest(changes, spark.createDataFrame([("tests/test_a.py",)], "path string"), spark.createDataFrame([], "src string, dst string"))
    data = json.loads(report.tests_json(changes, found).first().json)
    assert data["changed_files"] == [{"path": "a.py", "type": "modified", "added_lines": 3, "removed_lines": 1}, {"path": "b.py", "type": "added", "added_lines": 1, "removed_lines": 0}]
    assert data["test_command"] == "pytest tests/test_a.py -v" and data["test_suggestions"] == [{"test_file": "tests/test_a.py", "changed_file": "a.py", "match_reason": "direct name match", "confidence": 0.9}]
    assert report.tests_text(changes, found).first().text == (
        "Changed files and suggested tests:\n\n  a.py (modified)\n    -> tests/test_a.py (direct name match, confidence: 0.9)\n\n"
        "  b.py (added)\n    -> no test files found\n\nSuggested test command:\n  pytest tests/test_a.py -v"
    )


@pytest.fixture
def workspace(tmp_path):
    root = tmp_path / "project"
    for name, text in {"src/auth/login.py": "import m\ndef check(x): pass\n", "src/m.py": "", "app.py": "import auth.login\nimport pkg\n", "tests/test_login.py": "", "notes/login.md": "", "src/pkg/__init__.py": "", "venv/lib.py": "import app\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for name in ("staged", "last-commit", "refs/main"):
        (tmp_path / "diffs" / name).mkdir(parents=True)
    (tmp_path / "diffs" / "staged" / "one.diff").write_text(DIFF)
    (tmp_path / "diffs" / "refs" / "main" / "two.patch").write_text(DIFF.replace("yarn.lock", "other.lock"))
    (tmp_path / "diffs" / "last-commit" / "none.diff").write_text("\n")
    (tmp_path / "messages").mkdir()
    (tmp_path / "messages" / "one.head.txt").write_text("fix login\n")
    (tmp_path / "messages" / "one.pending.txt").write_text("wip\n")
    return tmp_path


def test_graph_cache(spark, workspace):
    root = str(workspace / "project")
    files = project.read(spark, root)
    assert cache.load(spark, cache.place(root)) is None
    built = {tuple(r) for r in cache.edges(spark, root, files).collect()}
    assert built == {("src/auth/login.py", "src/m.py"), ("app.py", "src/auth/login.py"), ("app.py", "src/pkg/__init__.py")}
    kept, times = cache.load(spark, cache.place(root))
    assert {tuple(r) for r in kept.collect()} == built and {r.path for r in times.collect()} == {"src/auth/login.py", "src/m.py", "src/pkg/__init__.py", "app.py", "tests/test_login.py"}
    cache.save(spark, cache.place(root), spark.createDataFrame([("a", "b")], "src string, dst string"), cache.mtimes(files))
    assert [tuple(r) for r in cache.edges(spark, root, project.read(spark, root)).collect()] == [("a", "b")]  # nothing changed: what is kept counts
    (workspace / "project" / "new.py").write_text("import app\n")
    assert ("new.py", "app.py") in {tuple(r) for r in cache.edges(spark, root, project.read(spark, root)).collect()}
    spark.range(1).select(F.lit("9").alias("value")).write.mode("overwrite").text(f"{cache.place(root)}/version")
    assert cache.load(spark, cache.place(root)) is None


def _main(capsys, workspace, *args):
    code = cli.main([args[0], "--diffs", str(workspace / "diffs"), "--project", str(workspace / "project"), *args[1:]])
    return code, capsys.readouterr().out


def test_command_line(spark, workspace, capsys):
    code, out = _main(capsys, workspace, "check", "--scope", "fix login", "--json")
    data = json.loads(out)
    assert code == 0 and [c["file_path"] for c in data["changed_files"]] == ["src/auth/login.py", "yarn.lock"] and data["commit_message_quality"] is None
    assert "notes/login.md" in data["intended_scope"]["target_files"] and not any(f.startswith("venv/") for f in data["intended_scope"]["target_files"])
    code, out = _main(capsys, workspace, "check", "--messages", str(workspace / "messages"), "--fail-on", "safe", "--sarif")
    assert code == 1 and "DG004" in {r["ruleId"] for r in json.loads(out)["runs"][0]["results"]}
    code, out = _main(capsys, workspace, "check", "--diff", "main", "--ignore", "*.lock")
    assert code == 0 and "Files changed: 1" in out and "\033[" not in out
    assert _main(capsys, workspace, "check", "--last-commit") == (0, "No changes found.\n")
    assert _main(capsys, workspace, "check", "--ignore", "src/", "--ignore", "*.lock") == (0, "All changes filtered by ignore patterns.\n")


def test_test_command_line(spark, workspace, capsys):
    assert _main(capsys, workspace, "test", "--command-only") == (0, "pytest tests/test_login.py -v\n")
    code, out = _main(capsys, workspace, "test", "--json")
    assert json.loads(out)["test_suggestions"][0]["match_reason"] == "direct name match"
    assert "yarn.lock (modified)\n    -> no test files found" in _main(capsys, workspace, "test")[1]
    assert "yarn.lock" not in _main(capsys, workspace, "test", "--ignore", "*.lock")[1]


def test_configuration_file(tmp_path, capsys):
    assert cli.main(["init", "--project", str(tmp_path)]) == 0 and cli.main(["init", "--project", str(tmp_path)]) == 1
    found, base = config.find(tmp_path), analyze.Config()
    assert (found.risk_safe, found.test_directories, found.test_patterns, found.test_command, found.prompt_files) == (base.risk_safe, base.test_directories, base.test_patterns, base.test_command, base.prompt_files)
    assert found.ignore[:2] == ("*.lock", "*.min.js") and found.fail_on == "danger"
    (tmp_path / "own-prompt").write_text("do it")
    (tmp_path / ".ripplescope.yml").write_text("scope:\n  prompt_files:\n    - own-prompt\n")
    assert config.prompt(tmp_path, config.find(tmp_path).prompt_files) == "do it"
    capsys.readouterr()
