import random
from datetime import datetime

from pyspark.sql import functions as F

from ripplescope.sources import cache, config, diffs, project
from ripplescope.streaming import gather
from ripplescope.streaming.watch import watch

DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,2 +1,3 @@ def run(x):
-import os
+import sys
+from m import y
+++z
@@ -9 +10 @@ class Box:
+const q = require('./q')
diff --git a/old.txt b/new.txt
similarity index 100%
rename from old.txt
rename to new.txt
diff --git a/gone.rb b/gone.rb
deleted file mode 100644
--- a/gone.rb
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_diff_parse(spark):
    rows = diffs.parse(spark.createDataFrame([("c", DIFF), ("empty", ""), ("blank", " \n"), ("none", None)], "change_set_id string, diff_text string")).orderBy("ordinal").collect()
    assert [(r.file_path, r.change_type, r.added_lines, r.removed_lines, r.language) for r in rows] == [("src/a.py", "modified", 3, 1, "python"), ("new.txt", "renamed", 0, 0, "unknown"), ("gone.rb", "deleted", 0, 1, "ruby")]
    first, moved, gone = rows
    assert first.functions_modified == ["run", "Box"] and first.imports_modified == ["sys", "m.y", "./q", "os"]
    assert [(h.old_start, h.old_count, h.new_start, h.new_count, h.function_header) for h in first.hunks] == [(1, 2, 1, 3, "def run(x):"), (9, 1, 10, 1, "class Box:")]
    assert moved.old_path == "old.txt" and gone.is_deleted and not gone.is_new_file


def test_python_facts():
    source = "import a.b\nfrom m import x\nfrom . import y\nfrom ..p import q\nclass K:\n    async def f(self):\n        import late\n        return self.g.h(1)\n"
    imports, functions, classes, calls = project.python_facts(source)
    assert imports == ["a.b", "m", ".y", "..p.q", "late"] and functions == [("f", 6, 8)] and classes == [("K", 5, 8)] and calls == ["self.g.h"]
    assert project.python_facts("def (") == ([], [], [], [])


def test_regex_imports_and_edges(spark):
    files = spark.createDataFrame(
        [
            ("web/app.js", "import x from './lib'\nconst y = require('../util.ts')\n// import z from './no'\n"),
            ("web/lib/index.js", ""), ("util.ts", ""), ("main.go", 'import (\n\t"fmt"\n\t"os"\n)\nimport "net"\n'), ("a.py", "import pkg.mod\nimport a\n"), ("src/pkg/mod.py", ""), ("x.c", '#include "y.h"\n'),
        ],
        "path string, source string",
    )
    names = {(r.path, r.name) for r in project.imports(files).collect()}
    assert {("web/app.js", "./lib"), ("web/app.js", "../util.ts"), ("main.go", "fmt"), ("main.go", "os"), ("main.go", "net"), ("x.c", "y.h")} <= names
    assert {(r.src, r.dst) for r in project.edges(files).collect()} == {("web/app.js", "web/lib/index.js"), ("web/app.js", "util.ts"), ("a.py", "src/pkg/mod.py")}
    assert [r.path for r in project.references(files, "fmt").collect()] == ["main.go"]
    assert [(r.name, r.line) for r in project.preceding(spark.createDataFrame([("f", 5)], "path string, line int"), spark.createDataFrame([("f", "a", 1), ("f", "b", 4), ("f", "c", 9)], "path string, name string, start_line int")).collect()] == [("b", 5)]


def test_config(tmp_path):
    (tmp_path / ".ripplescope.yml").write_text("thresholds:\n  risk_safe: 0.25  # low\nignore:\n  - 'docs/'\nscope:\n  areas:\n    auth:\n      files:\n        - src/a.py\nhook:\n  fail_on: review\n")
    (tmp_path / ".ripplescopeignore").write_text("# no\n\n*.lock\n!keep.lock\n")
    (tmp_path / "deep").mkdir()
    found = config.find(tmp_path / "deep")
    assert found.risk_safe == 0.25 and found.ignore == ("docs/", "*.lock", "!keep.lock") and found.areas == {"auth": {"files": ["src/a.py"]}} and found.fail_on == "review"
    assert config.parse("a: yes\nb: [1, 'x']\nc: ~\nd: 1.5\ne: 'q # r'") == {"a": True, "b": [1, "x"], "c": None, "d": 1.5, "e": "q # r"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.diff").write_text(DIFF)
    seen = []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda rows, epoch: seen.extend(rows.select("change_set_id", "file_path").collect()), once=True).awaitTermination(120)
    assert {tuple(r) for r in seen} == {("one", "src/a.py"), ("one", "new.txt"), ("one", "gone.rb")}


def test_graph_cache_follows_changes(spark, tmp_path, monkeypatch):
    """After any adds, removals and touches it equals a full build; only files that changed are parsed."""
    rng, names = random.Random(1), [f"pkg/m{i}.py" for i in range(12)] + [f"web/c{i}.ts" for i in range(8)] + ["web/index.js", "src/pkg/m3.py", "pkg/m4/__init__.py"]
    parsed = []
    plain = project.imports

    def counted(files):
        parsed.append({r.path for r in files.select("path").collect()})
        return plain(files)

    def text(path):
        if path.endswith(".py"):
            return "\n".join(f"import pkg.m{rng.randrange(14)}" for _ in range(3)) + "\nimport os\n"
        return "\n".join(f"import x from '{rng.choice(['./c', '../web/c', './c'])}{rng.randrange(10)}';" for _ in range(2)) + "\nimport y from '.';\n"

    state, clock = {n: (text(n), 0) for n in names[::2]}, 0
    frame = lambda: spark.createDataFrame([(p, s, datetime.fromtimestamp(1_000_000 + t)) for p, (s, t) in state.items()], "path string, source string, modified timestamp")
    for step in range(6):
        before = dict(state)
        clock += 1
        for n in rng.sample(names, 4) if step else []:
            if n in state and rng.random() < 0.5:
                del state[n]
            else:
                state[n] = (text(n), clock)
        parsed.clear()
        monkeypatch.setattr(project, "imports", counted)
        found = {tuple(r) for r in cache.edges(spark, str(tmp_path), frame()).collect()}
        monkeypatch.setattr(project, "imports", plain)
        assert found == {tuple(r) for r in project.edges(frame().select("path", "source")).collect()}
        changed = {n for n in state if state[n] != before.get(n)} if step else set(state)
        assert parsed == ([changed] if changed or step == 0 else [set()])
    assert len([p for p in (tmp_path / project.CACHE).iterdir() if p.name.startswith("state-")]) == 2
    state.clear()
    assert cache.edges(spark, str(tmp_path), frame()).count() == 0


def test_functions_by_language(spark):
    files = spark.createDataFrame([("a.py", "async def go(x):\nfunction no(a) {\n"), ("b.ts", "function go(a) {\ndef no():\nconst f = async (x) => 1"), ("c.php", "function go(a) {\ndef yes"), ("d.rs", "pub fn go<T>("), ("e.go", "func go(x)\nfn no(")], "path string, source string")
    assert {(r.path, r.name) for r in project.regex_functions(files, by_language=True).collect()} == {("a.py", "go"), ("b.ts", "go"), ("b.ts", "f"), ("c.php", "go"), ("c.php", "yes"), ("d.rs", "go"), ("e.go", "go")}


def test_listing_on_executors(spark, tmp_path):
    for name in ("a.py", "pkg/__init__.py", "pkg/deep/er/_x.txt", ".git/no", "node_modules/no.js", "pkg/venv/no.py", ".hidden/yes"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    found = project.listing(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"a.py", "pkg/__init__.py", "pkg/deep/er/_x.txt", ".hidden/yes"} and found.filter("modified is null").count() == 0
    assert "LocalTableScan" not in found._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty").mkdir()
    assert project.listing(spark, str(tmp_path / "empty")).count() == 0


def test_pieces_of_change_sets_in_any_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        parts = rng.randint(1, 5)
        rows += [(f"s{k}", i, parts, f"{k}:{i};") for i in range(parts) if not (k % 4 == 0 and i == 1)]
    rows += rng.choices(rows, k=15) + [("s1", None, 1, "x"), (None, 0, 1, "x"), ("s2", 9, 3, "x"), ("s2", -1, 3, "x")]
    kinds = "change_set_id string, part int, parts int, text string"
    want = sorted(map(tuple, gather.whole(spark.createDataFrame(rows, kinds)).collect()))
    assert want and all(x[1] == "".join(f"{x[0][1:]}:{i};" for i in range(x[1].count(";"))) for x in want)
    for trial, size in enumerate((3, 50)):
        rng.shuffle(rows)
        folder = tmp_path / f"in{trial}"
        for at in range(0, len(rows), size):
            spark.createDataFrame(rows[at : at + size], kinds).coalesce(1).write.mode("append").json(str(folder))
        seen = []
        for half in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1 if size > 3 else 8).json(str(folder))
            writer = gather.gathered(stream).writeStream.option("checkpointLocation", str(tmp_path / f"state{trial}")).foreachBatch(lambda batch, _: seen.extend(map(tuple, batch.collect())))
            writer.trigger(availableNow=True).start().awaitTermination(240)
        assert sorted(seen) == want
