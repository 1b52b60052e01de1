import json
import random
import time

import pytest
from pyspark.sql import functions as F

from ripplescope.functions import globs, languages, paths
from ripplescope.operators import commits, graph, ignore, joins, relevance, risk, scope, test_mapping
from ripplescope.plans import analyze, report, storage
from ripplescope.sources import project as sources

EDGES = [("app.py", "auth/session.py"), ("auth/login.py", "auth/session.py"), ("auth/session.py", "utils/val.py"), ("auth/login.py", "utils/val.py"), ("tests/test_login.py", "auth/login.py")]
FILES = ["app.py", "auth/login.py", "auth/session.py", "utils/val.py", "tests/test_login.py", "tests/auth/test_other.py"]


@pytest.fixture(scope="module")
def project(spark):
    return spark.createDataFrame([(f,) for f in FILES], "path string"), spark.createDataFrame(EDGES, "src string, dst string")


def _changes(spark, *rows):
    data = [("c", i, p, k, a, r, k == "added", k == "deleted", f) for i, (p, k, a, r, f) in enumerate(rows)]
    return spark.createDataFrame(data, "change_set_id string, ordinal int, file_path string, change_type string, added_lines long, removed_lines long, is_new_file boolean, is_deleted boolean, functions_modified array<string>")


def _scope(spark, targets, concepts, confidence):
    return spark.createDataFrame([("c", "d", targets, [], concepts, confidence, "cli")], "change_set_id string, description string, target_files array<string>, target_functions array<string>, target_concepts array<string>, confidence double, source string")


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/b.c.py", ".bashrc", "x", "a.", "d/.env.example")], "p string").select(paths.stem(F.col("p")), paths.suffix(F.col("p")), paths.parent(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("b.c", ".py", "a"), (".bashrc", "", "."), ("x", "", "."), ("a.", "", "."), (".env", ".example", "d")]
    assert spark.range(1).select(paths.normal(F.lit("./a//b/./c/")), paths.normal(F.lit(""))).first()[:] == ("a/b/c", ".")


def test_patterns(spark):
    hit = lambda test, path, *p: spark.range(1).select(test(F.lit(path), *p)).first()[0]
    assert hit(globs.user_ignored, "src/apifoo.py", ["src/api/"]) and not hit(globs.user_ignored, "a.lock", ["!a.lock"])
    assert hit(globs.at_any_depth, "x/dist/a.js", "dist/") and hit(globs.at_any_depth, "x/a.min.js", "*.min.js") and not hit(globs.at_any_depth, "distx/a", "dist/")
    assert hit(globs.matches, "a1b", "a[0-9]?") and not hit(globs.matches, "a1b", "a[!0-9]b") and hit(globs.matches, "a[b", "a[b")


def test_downstream(spark, project):
    nodes, edges = project
    changes = _changes(spark, ("utils/val.py", "modified", 1, 1, []))
    rows = {r.file_path: (r.distance, r.via_files, round(r.risk_contribution, 6)) for r in graph.downstream(changes, nodes, edges).collect()}
    assert rows == {
        "auth/session.py": (1, ["utils/val.py", "auth/session.py"], 0.8),
        "auth/login.py": (1, ["utils/val.py", "auth/login.py"], 0.6),
        "app.py": (2, ["utils/val.py", "auth/session.py", "app.py"], 0.2),
        "tests/test_login.py": (2, ["utils/val.py", "auth/login.py", "tests/test_login.py"], 0.2),
    }
    with pytest.raises(ValueError):
        graph.downstream(changes, nodes, edges, 4)


def test_distance(spark, project):
    nodes, edges = project
    pairs = spark.createDataFrame([("app.py", "utils/val.py"), ("utils/val.py", "app.py"), ("no", "no"), ("no", "app.py")], "src string, dst string")
    assert {(r.src, r.dst): r.distance for r in graph.distance(pairs, nodes, edges, 2).collect()} == {("app.py", "utils/val.py"): 2, ("utils/val.py", "app.py"): -1, ("no", "no"): 0, ("no", "app.py"): -1}


def test_phantoms(spark, project):
    nodes, edges = project
    changes = _changes(spark, ("auth/login.py", "modified", 3, 1, []), ("other/thing.py", "modified", 8, 2, ["f"]), ("yarn.lock", "modified", 9, 0, []), ("utils/val.py", "modified", 9, 0, []))
    found = relevance.phantoms(relevance.scored(changes, _scope(spark, ["auth/login.py"], ["login", "auth"], 1.0), nodes, edges))
    rows = {r.file_path: r for r in found.collect()}
    assert set(rows) == {"other/thing.py", "yarn.lock"}
    assert rows["yarn.lock"].severity == "info" and rows["other/thing.py"].severity == "warning"
    assert rows["other/thing.py"].change_summary == "Modified other/thing.py (functions: f) [+8/-2]"
    assert rows["other/thing.py"].reason == "not in scope target files; no path overlap with scope; no import-chain connection to scope; relevance=0.00"
    assert round(rows["other/thing.py"].confidence, 6) == 1.0


def test_risk(spark, project):
    nodes, edges = project
    changes = _changes(spark, ("a.py", "modified", 5, 45, []), ("tests/test_b.py", "added", 0, 0, []))
    scopes = _scope(spark, ["a.py"], [], 0.9)
    row = risk.risk(changes, scopes, relevance.phantoms(relevance.scored(changes, scopes, nodes, edges)), edges, "danger").first()
    assert (row.complexity, row.deletion, row.test_coverage, row.scope_overflow) == (0.1, 0.9, 0.5, 0.0)
    levels = spark.createDataFrame([(0.8, 0.3), (0.8, 0.9), (0.1, 0.9), (0.4, 0.9)], "s double, c double").select(risk.classify(F.col("s"), F.col("c"))).collect()
    assert [r[0] for r in levels] == ["review", "danger", "safe", "review"]


def test_scope_text(spark):
    texts = spark.createDataFrame([("c", " Fix login() in src/App.jsx and the config.json ", 0.8, "cli")], "change_set_id string, text string, confidence double, source string")
    row = scope.parse(texts).first()
    assert row.target_files == ["config.js", "src/App.js"] and row.target_functions == ["login"] and row.target_concepts == ["app", "config", "fix", "json", "jsx", "login", "src"]


def test_commit_messages(spark):
    changes = _changes(spark, ("src/auth/login.py", "modified", 1, 1, ["check"]))
    messages = spark.createDataFrame([("c", "fix"), ("d", "")], "change_set_id string, message string")
    rows = {r.change_set_id: r for r in commits.quality(messages, changes).collect()}
    assert round(rows["c"].score, 2) == 0.2 and rows["c"].is_vague and rows["c"].suggested_improvement == "fix(login): update login" and len(rows["c"].issues) == 4
    assert rows["d"].score == 0.0 and rows["d"].issues == ["Empty commit message"]


def test_test_mapping(spark, project):
    nodes, edges = project
    files = nodes.withColumn("source", F.when(F.col("path").contains("other"), "def test_check(): pass").otherwise(""))
    changes = _changes(spark, ("auth/login.py", "modified", 1, 1, ["check"]), ("auth/session.py", "deleted", 0, 3, []))
    rows = {r.test_file: (r.match_reason, r.confidence) for r in test_mapping.suggest(changes, files, edges).collect()}
    assert rows == {"tests/test_login.py": ("direct name match", 0.9), "tests/auth/test_other.py": ("directory match", 0.7)}
    assert test_mapping.command(test_mapping.suggest(changes, files, edges)).first().command == "pytest tests/auth/test_other.py tests/test_login.py -v"


def test_whole_analysis(spark, project):
    nodes, edges = project
    changes = _changes(spark, ("auth/login.py", "modified", 3, 1, []), ("yarn.lock", "modified", 9, 0, []))
    inputs = spark.createDataFrame([("c", None, "fix auth/login.py", "", "wip")], "change_set_id string, prompt string, cli_scope string, head_message string, pending_message string")
    reports = analyze.analyze(changes, inputs, nodes, edges)
    data = json.loads(report.json(reports).first().json)
    assert data["intended_scope"]["confidence"] == 0.8 and [p["file_path"] for p in data["phantom_changes"]] == ["yarn.lock"] and {t["test_file"] for t in data["suggested_tests"]} == {"tests/test_login.py", "tests/auth/test_other.py"}
    log = json.loads(report.sarif(reports).first().sarif)
    assert {r["ruleId"] for r in log["runs"][0]["results"]} >= {"DG001", "DG004"}
    assert "### :ghost: Phantom Changes (1 files)" in report.markdown(reports).first().markdown


def test_languages(spark):
    files = spark.createDataFrame([(p,) for p in ("a.py", "b.pyw", "c.kt", "d.txt", "e.PY")], "path string")
    assert [tuple(r) for r in languages.frequency(files).collect()] == [("python", 3), ("kotlin", 1)]


def test_last_event_before_each_line(spark, monkeypatch):
    rng = random.Random(2)
    lines = [(p, rng.randint(-3, 400)) for p in "abc" for _ in range(300)] + [("a", None), (None, 4), ("no events", 3)]
    starts = [(p, f"f{rng.randint(0, 99):02d}", rng.randint(0, 400)) for p in "ab" for _ in range(60)] + [("c", "only", 7), ("c", None, 300), (None, "x", 1), ("a", "y", None)]
    rows, events = spark.createDataFrame(lines, "path string, line int"), spark.createDataFrame(starts, "path string, name string, line int")
    want = {}
    for p, at in lines:
        before = [(x[2], x[1]) for x in starts if at is not None and p is not None and x[0] == p and x[2] is not None and x[2] <= at]
        if before:
            last = max(b[0] for b in before)
            want[p, at] = min((b[1] for b in before if b[0] == last and b[1] is not None), default=None)
    for stretch in (1, 16, 1 << 14):  # one line a stretch, some, all in one
        found = joins.last_before(rows, events, "path", "line", "name", stretch).collect()
        assert {(r.path, r.line): r.name for r in found} == want and len(found) == len(want)
    assert joins.last_before(rows, events.filter("false"), "path", "line", "name").count() == joins.last_before(rows.filter("false"), events, "path", "line", "name").count() == 0


def test_narrowest_span_around_each_line(spark, monkeypatch):
    rng = random.Random(3)
    spans = [("a", f"s{k}", s := rng.randint(0, 300), s + rng.choice([0, 0, 3, 17, 200])) for k in range(80)] + [("a", "whole", 0, 500), ("b", "one", 5, 5), ("b", "twin", 5, 5), ("b", "none", 9, 8), ("a", "wide", 0, 2**31 - 2)]
    lines = [(p, k) for p in "abc" for k in range(0, 510, 3)] + [("b", 5), ("b", 5), ("b", 8), ("a", 1_999_999_999)]
    want = {}
    for p, k in lines:
        around = [(e - s, s, n) for q, n, s, e in spans if q == p and s <= k <= e]
        if around:
            want[p, k] = min(around)[2]
    for levels in (3, 20):
        monkeypatch.setattr(joins, "LEVELS", levels)
        mine = [x for x in spans if levels == 20 or x[3] < 600]
        near = {k: v for k, v in want.items() if levels == 20 or v != "wide"}
        found = joins.narrowest_around(spark.createDataFrame(lines, "path string, line int"), spark.createDataFrame(mine, "path string, name string, start_line int, end_line int"), "path", "line", "start_line", "end_line", "name").collect()
        assert {(r.path, r.line): r.name for r in found} == near and len(found) == len(near)


def test_hot_file_is_many_tasks_and_linear(spark):
    """20,000 lines and 5,000 starts or spans of one file."""
    lines = spark.range(1, 20_001).selectExpr("'f' as path", "cast(id as int) as line")
    starts = spark.range(5_000).selectExpr("'f' as path", "concat('n', id) as name", "cast(4 * id + 1 as int) as start_line", "cast(20000 - id as int) as end_line")
    began = time.perf_counter()
    assert sources.preceding(lines, starts.drop("end_line")).filter("name = concat('n', cast((line - 1) div 4 as string))").count() == 20_000
    assert sources.innermost(lines, starts).count() == 20_000
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("hot", [1, 3, 10**6])
def test_hot_keys_are_split_on_both_sides(spark, hot):
    left = [(k % 3, i) for i, k in enumerate([0] * 20 + [1] * 3 + [2, 5])] + [(None, 1)]
    right = [(k % 3, i) for i, k in enumerate([0] * 4 + [1] * 15 + [2])] + [(None, 2)]
    found = joins.spread_join(spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int"), "k", hot).collect()
    assert sorted((r.k, r.a, r.b) for r in found) == sorted((k, a, b) for k, a in left for j, b in right if k == j and k is not None)


def test_hub_with_many_dependents(spark, monkeypatch):
    """100,000 files depend on one that several change sets touch, some of them by another way."""
    edges = spark.range(100_000).selectExpr("concat('d', id) as src", "'hub' as dst").unionByName(spark.createDataFrame([("hub", "base"), ("d1", "base"), ("z", "d2")], "src string, dst string"))
    nodes = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    changes = spark.createDataFrame([(1, 1, "hub"), (2, 1, "base"), (2, 2, "d7"), (3, 1, "alone")], "change_set_id int, ordinal int, file_path string")
    found = graph.downstream(changes, nodes, edges).cache()
    assert {r.change_set_id: r["count"] for r in found.groupBy("change_set_id").count().collect()} == {1: 100_001, 2: 100_001}
    some = {(r.change_set_id, r.file_path): (r.distance, r.via_files) for r in found.filter("file_path in ('z', 'd1', 'd2', 'd7')").collect()}
    assert some[1, "z"] == (2, ["hub", "d2", "z"]) and some[2, "z"] == (3, ["base", "hub", "d2", "z"]) and some[2, "d1"] == (1, ["base", "d1"]) and (2, "d7") not in some
    found.unpersist()


def test_distances_in_random_graphs(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(40)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(55)}
    edges = {(a, b) for a, b in edges if a != b}
    pairs = [(rng.choice([*names, "no"]), rng.choice([*names, "no"])) for _ in range(150)]
    found = graph.distance(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame(sorted(edges), "src string, dst string"))
    for r in found.collect():
        level, seen, d = {r.src}, {r.src}, 0
        while level and r.dst not in level:
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            d += 1
        assert r.distance == (0 if r.src == r.dst else -1 if r.src == "no" or not level else d)
    assert graph.distance(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "path string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_pairs_without_a_way_are_not_followed(spark, monkeypatch):
    """Two long ways with a loop on each, and pairs across them: all pairs are kept once, not at each step."""
    kept = []

    def settled(df):
        table = real(df)
        if {"src", "dst"} <= set(table.columns):
            kept.append(table.count())
        return table

    real = graph.settled
    monkeypatch.setattr(graph, "settled", settled)
    edges = [(f"{w}{i}", f"{w}{i + 1}") for w in "ab" for i in range(12)] + [("a12", "a9"), ("b12", "b9")]
    names = [f"{w}{i}" for w in "ab" for i in range(13)]
    pairs = [(f"{v}{i}", f"{w}{k}") for v, w in ("ab", "ba") for i in range(13) for k in range(13)] + [("a0", "a5"), ("a12", "a10"), ("a3", "a3"), (None, "a1"), ("no", "a1"), ("a0", "a5")]
    tables = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame(edges, "src string, dst string")
    want = sorted((str(a), b, {("a0", "a5"): 5, ("a12", "a10"): 2, ("a3", "a3"): 0}.get((a, b), -1)) for a, b in pairs)
    assert sorted((str(r.src), r.dst, r.distance) for r in graph.distance(*tables).collect()) == want
    assert sum(kept) < 1.5 * len(pairs)
    monkeypatch.setattr(graph, "LABEL_ROUNDS", 1)  # labels without all bits aren't used
    assert sorted((str(r.src), r.dst, r.distance) for r in graph.distance(*tables).collect()) == want


def test_patterns_of_many_projects(spark):
    """Against fnmatch, with sets, backward ranges, unclosed brackets and patterns without a literal."""
    from fnmatch import fnmatchcase

    rng = random.Random(6)
    words = ["a", "src", "api", "x[1]", "é", "lock", "b.py", "c.min.js", "-", "^", "a&&b", "]"]
    paths = {("/".join(rng.choices(words, k=rng.randint(1, 4)))) for _ in range(120)} | {"", "a\nb"}
    pieces = [*words, "*", "*", "?", "[a-c]", "[!a-c]", "[z-a]", "[!z-a]", "[]a]", "[!]a]", "[", "[a", "[^a]", "/", "."]
    patterns = [(rng.choice(["p", "q"]), k, "".join(rng.choices(pieces, k=rng.randint(1, 5)))) for k in range(300)] + [("p", 400, "*"), ("q", 401, "/"), ("q", 401, "a"), ("p", 1, None), (None, 1, "*")]
    rows = [(p, x) for p in ("p", "q", "none") for x in paths] + [("p", "a"), ("p", None), (None, "a")]
    found = ignore.first_matches(spark.createDataFrame(rows, "project string, path string"), spark.createDataFrame(patterns, "project string, ordinal int, pattern string"))
    want = {}
    for p, x in set(rows):
        hit = [(k, t) for q, k, t in patterns if p is not None and x is not None and q == p and t is not None and (x.startswith(t.rstrip("/")) if t.endswith("/") else fnmatchcase(x, t))]
        if hit:
            want[p, x] = min(hit)
    assert {(r.project, r.path): (r.ordinal, r.pattern) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_patterns_and_many_areas(spark):
    """10,000 patterns of one project and 100,000 areas."""
    patterns = spark.range(10_000).selectExpr("1 as project", "id as ordinal", "case id % 3 when 0 then concat('src/m', id, '/*.py') when 1 then concat('*_', id, '.js') else concat('*name', id, 'x*') end as pattern")
    paths = spark.range(3_000).selectExpr("1 as project", "case id % 3 when 0 then concat('src/m', id, '/a.py') when 1 then concat('lib/f_', id, '.js') else concat('lib/name', id, 'x.c') end as path")
    assert ignore.first_matches(paths, patterns).filter("ordinal is not null").count() == 3_000
    areas = spark.range(100_000).selectExpr("concat('Area', id, 'z') as area", "'files' as kind", "concat('f', id) as path")
    scopes = spark.createDataFrame([(1, "Touch AREA77z and é", ["area99999z"], ["x"]), (2, None, [], []), (3, "area 77z " * 3000, [], ["y"])], "change_set_id int, description string, target_concepts array<string>, target_files array<string>")
    enriched = scope.enrich(scopes, areas)
    assert {r.change_set_id: r.target_files for r in enriched.collect()} == {1: ["f77", "f99999", "x"], 2: [], 3: ["y"]}
    assert "NestedLoop" not in enriched._jdf.queryExecution().executedPlan().toString()


def test_equal_patterns_of_a_project_are_one(spark):
    """20,000 paths under the same 20,000 patterns, and as many whole paths that begin alike."""
    patterns = spark.range(40_000).selectExpr("1 as project", "id as ordinal", "case when id % 2 = 0 then '*/api/*' else concat('src/common/folder/file_', id, '*.py*') end as pattern")
    paths = spark.range(20_000).selectExpr("1 as project", "concat(if(id % 4 = 0, 'x/api/', 'src/common/folder/file_'), 1 + 2 * id, '.py') as path")
    began = time.perf_counter()
    found = ignore.first_matches(paths, patterns)
    assert {(r.start, r.ordinal): r["count"] for r in found.groupBy(F.substring("path", 1, 5).alias("start"), F.when(F.col("ordinal") > 0, 1).otherwise(0).alias("ordinal")).count().collect()} == {("x/api", 0): 5_000, ("src/c", 1): 15_000}
    assert time.perf_counter() - began < 30


def _shuffled(spark):
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lines_are_shuffled_as_bits(spark):
    """160 lines of each of 500 files: fewer rows are shuffled than there are lines."""
    lines = spark.range(500).selectExpr("concat('f', id) as path", "explode(sequence(1, 160)) as line")
    spans = spark.range(500).selectExpr("concat('f', id) as path", "explode(array(struct('a' as name, 1 as start_line, 160 as end_line), struct('b' as name, 60 as start_line, 70 as end_line))) as s").select("path", "s.*")
    before = _shuffled(spark)
    assert sources.innermost(lines, spans).groupBy("name").count().orderBy("name").collect() == [("a", 149 * 500), ("b", 11 * 500)]
    assert sources.preceding(lines, spans.drop("end_line")).groupBy("name").count().orderBy("name").collect() == [("a", 59 * 500), ("b", 101 * 500)]
    assert _shuffled(spark) - before < 500 * 160


def test_numbers_as_the_shortest_text(spark):
    """As Python writes them; Java 17 writes some of these with another digit."""
    from ripplescope.functions import numbers

    values = sorted({w * (0.5 + 0.5 * (n / m)) for w in (0.8, 0.4, 0.1, 0.001) for m in range(1, 60) for n in range(m + 1)} | {0.0, 1.0, 4e-4, 2e-3, 5.5, 0.1 + 0.2})
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", numbers.shortest(F.col("x")).alias("text"), F.col("x").cast("string").alias("java")).collect()
    assert [(r.x, r.text) for r in found if r.text != repr(r.x)] == []
    assert any(r.java != repr(r.x) for r in found)


def test_areas_of_many_files(spark):
    """1,000 scopes of an area with 500 files: no row is shuffled for each scope and file."""
    areas = spark.range(500).selectExpr("'red' as area", "'files' as kind", "concat('f', id) as path")
    scopes = spark.range(1_000).selectExpr("id as change_set_id", "'paint it red' as description", "array('blue') as target_concepts", "array('x', 'f7') as target_files")
    before = _shuffled(spark)
    assert scope.enrich(scopes, areas).select(F.size("target_files").alias("n")).distinct().collect() == [(501,)]
    assert _shuffled(spark) - before < 100_000


def test_tests_of_hot_folders_and_functions_are_split(spark):
    changes = spark.range(30_000).selectExpr("id as change_set_id", "1 as ordinal", "concat('api/m', id, '.py') as file_path", "array('run', 'Box::open') as functions_modified")
    tests = spark.createDataFrame([("tests/api/test_a.py", "tests", "def test_run"), ("tests/api/test_b.py", "tests", "def test_Box::open")], "path string, root string, source string")
    for found, n in ((test_mapping.by_directory(changes, tests), 60_000), (test_mapping.by_function(changes, tests), 60_000)):
        assert "__l_part" in found._jdf.queryExecution().executedPlan().toString() and found.count() == n


def test_impacts_without_named_files(spark):
    """Files that scopes name are left out where the nearest ways are chosen, as afterwards."""
    rng = random.Random(9)
    edges = spark.createDataFrame(sorted({(f"n{rng.randint(0, 30)}", f"m{rng.randint(0, 9)}") for _ in range(60)} | {(f"m{k}", f"n{k}") for k in range(10)}), "src string, dst string")
    nodes = edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct()
    changes = spark.createDataFrame([(c, k, f"{rng.choice('mn')}{3 * k + c % 3}") for c in range(6) for k in range(3)], "change_set_id int, ordinal int, file_path string")
    scopes = spark.createDataFrame([(c, [f"n{k}" for k in range(c, 31, 3)] + ["none"]) for c in range(5)], "change_set_id int, target_files array<string>")
    want = graph.out_of_scope(graph.downstream(changes, nodes, edges), scopes).collect()
    assert want and sorted(graph.downstream(changes, nodes, edges, scopes=scopes).collect()) == sorted(want)


def test_coverage_looks_only_where_tests_are(spark):
    """1,000 change sets of 20 files without a test: their files are not shuffled for each place where a test may lie."""
    changes = spark.range(20_000).selectExpr("id % 1000 as change_set_id", "id as ordinal", "concat('src/a/f', id, '.py') as file_path")
    changes = changes.unionByName(spark.createDataFrame([(7, -1, "src/a/test_f7.py"), (8, -1, "x/test_f9.py")], "change_set_id long, ordinal long, file_path string"))
    before = _shuffled(spark)
    found = {r.change_set_id: r.test_coverage for r in risk.test_coverage(changes).filter("test_coverage < 1").collect()}
    assert found == {7: 1.0 - 2 / 21, 8: 1.0 - 1 / 21}
    assert _shuffled(spark) - before < 60_000


def test_products_are_dealt_to_tasks_by_their_pairs(spark):
    """Few rows of one key that make many pairs are no single task, and the pairs are those of a plain join."""
    left = [(k, a) for k, n in ((1, 70), (2, 3), (3, 1), (None, 2)) for a in range(n)]
    right = [(k, b) for k, n in ((1, 41), (2, 30), (4, 1), (None, 2)) for b in range(n)] + [(2, 0)]
    frames = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int")
    found = sorted((r.k, r.a, r.b) for r in joins.product_join(*frames, "k", 20).collect())
    assert found == sorted((k, a, b) for k, a in left for j, b in right if k == j and k is not None)
    changes = spark.range(0, 20_000, 1, 1).selectExpr("id as change_set_id", "1 as ordinal", "concat('api/m', id, '.py') as file_path", "array('run') as functions_modified")
    tests = spark.range(0, 70, 1, 1).selectExpr("concat('tests/api/test_n', id, '.py') as path", "'tests' as root", "'def test_run(): pass' as source")
    for pairs in (test_mapping.by_directory(changes, tests), test_mapping.by_function(changes, tests)):
        dealt = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in dealt) == 1_400_000 and len(dealt) > 1


def test_tables_dealt_by_a_key_lie_as_they_are_joined(spark):
    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.requireAllClusterKeysForCoPartition")
    before = [spark.conf.get(n) for n in names]
    left = _shuffle_files(spark)
    rows = storage.settled(spark.range(1_000).selectExpr("id % 10 as k", "id as v", "if(id = 7, null, id) as n"), "k")
    assert _shuffle_files(spark) <= left and [spark.conf.get(n) for n in names] == before
    counted = rows.join(rows.groupBy("k").agg(F.count("n").alias("all")).hint("merge"), "k")
    assert "hashpartitioning" not in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.groupBy("all").count().orderBy("all").collect() == [(99, 100), (100, 900)]


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _shuffled_bytes(spark):
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_wide_changes_are_scored_where_they_lie(spark):
    """2 MB of functions' names: they are not shuffled to be judged, and nothing that was stays on disk."""
    changes = spark.range(2_000).selectExpr("id % 50 as change_set_id", "id as ordinal", "concat('src/f', id % 90, '.py') as file_path", "9L as added_lines", "id % 3 as removed_lines", "false as is_new_file", "false as is_deleted", "transform(sequence(1, 15), i -> sha2(concat(id, '/', i), 256)) as functions_modified")
    scopes = spark.range(50).selectExpr("id as change_set_id", "'x' as description", "array(concat('src/f', id, '.py')) as target_files", "cast(array() as array<string>) as target_functions", "array('f1') as target_concepts", "0.8D as confidence")
    edges = spark.range(80).selectExpr("concat('src/f', id, '.py') as src", "concat('src/f', id + 1, '.py') as dst")
    nodes = spark.range(70).selectExpr("concat('src/f', id, '.py') as path")
    changes, scopes = storage.settled(changes, "change_set_id"), storage.settled(scopes, "change_set_id")
    before, left = _shuffled_bytes(spark), _shuffle_files(spark)
    judged = storage.settled(relevance.scored(changes, scopes, nodes, edges).select(*relevance.JUDGED), "change_set_id", True)
    assert _shuffled_bytes(spark) - before < 300_000 and _shuffle_files(spark) <= left
    assert judged.count() == 2_000
    near = {(r.change_set_id, r.file_path): (r.chain, r.linked, r.centrality) for r in judged.collect()}
    for (c, path), (chain, linked, central) in near.items():
        hop = int(path[5:-3]) - c
        assert chain == {0: 1.0, 1: 0.7, 2: 0.4}.get(hop, 0.0) and linked == (hop in (0, 1, 2)) and central == (1 <= hop + c <= 80)
    given = risk.centrality_factor(judged, edges).collect()
    assert sorted(given) == sorted(risk.centrality_factor(changes, edges).collect())


def test_many_patterns_are_no_broadcast(spark):
    """Patterns whose file is small, as they are much alike: they are merged with the paths by their keys."""
    patterns = spark.range(3_000).selectExpr("id % 2 as project", "id as ordinal", "case when id % 3 = 0 then concat('src/common/f', id, '.py') else concat('src/common/f', id, '*') end as pattern")
    found = ignore.first_matches(spark.range(3_000).selectExpr("id % 2 as project", "concat('src/common/f', id, '.py') as path"), patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.filter("path like concat('src/common/f', ordinal, '%')").count() == found.count() == 3_000
