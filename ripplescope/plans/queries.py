"""Registered queries over the test tables, and the same in DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.functions import globs, languages, paths
from ripplescope.operators import commits, graph, ignore, relevance, risk, scope, test_mapping
from ripplescope.plans import analyze, report, report_sql
from ripplescope.plans.adapters import Adapters, prelude
from ripplescope.plans.adapters import changes as _changes
from ripplescope.plans.adapters import nodes as _nodes
from ripplescope.plans.adapters import scopes as _scopes
from ripplescope.plans.storage import settled
from ripplescope.sources import diffs, project, references

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Views that most plans read several times.
_KEPT = ("changes", "scope", "edges")


def query(sql: str | None = None, views: tuple[str, ...] = (), settle: tuple[str, ...] = ()) -> Callable:
    """Register a function of Adapters under its name, with its SQL over the named views; `settle` are derived once."""
    def keep(build: Callable[[Adapters], DataFrame]) -> Callable[[Adapters], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Adapters(spark, sf_dir, settle))
        if sql is not None:
            head = prelude(*views) if views else ""
            text = sql.lstrip()
            if text.startswith("+r "):
                head, text = head.replace("WITH", "WITH RECURSIVE", 1), f"+{text.removeprefix('+r')}"
            ORACLE[build.__name__] = f"{head}{',' if head and text.startswith('+') else ' ' if head else ''}{text.removeprefix('+')}"
        return build

    return keep


def _r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


# ---- graph -------------------------------------------------------------------------------------------------


@query("SELECT src, dst FROM v_edges", ("v_edges",))
def edges(a: Adapters) -> DataFrame:
    return a.edges


@query("SELECT f.path, coalesce(c.n, 0) AS centrality FROM v_files f LEFT JOIN (SELECT dst, count(*) AS n FROM v_edges GROUP BY dst) c ON c.dst = f.path", ("v_files", "v_edges"))
def centrality(a: Adapters) -> DataFrame:
    return graph.centrality(_nodes(a), a.edges)


@query("SELECT dst AS path, count(*) AS centrality FROM v_edges GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 10", ("v_edges",))
def top_central(a: Adapters) -> DataFrame:
    return graph.top_central(a.edges, 10)


@query("SELECT dst AS path, string_agg(src, ',' ORDER BY src) AS dependents FROM v_edges GROUP BY dst", ("v_edges",))
def dependents(a: Adapters) -> DataFrame:
    return graph.dependents(a.edges).withColumn("dependents", F.array_join("dependents", ","))


@query("SELECT src AS path, string_agg(dst, ',' ORDER BY dst) AS dependencies FROM v_edges GROUP BY src", ("v_edges",))
def dependencies(a: Adapters) -> DataFrame:
    return graph.dependencies(a.edges).withColumn("dependencies", F.array_join("dependencies", ","))


_REACH = """+ r0 AS (SELECT DISTINCT s.target AS seed, s.target AS path, 0 AS distance FROM v_scope s),
r1 AS (SELECT DISTINCT seed, e.dst AS path, 1 AS distance FROM r0 JOIN v_edges e ON e.src = r0.path),
r2 AS (SELECT DISTINCT seed, e.dst AS path, 2 AS distance FROM r1 JOIN v_edges e ON e.src = r1.path),
reach AS (SELECT seed, path, min(distance) AS distance FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY seed, path)"""


@query(_REACH + " SELECT seed, path, distance FROM reach", ("v_scope", "v_edges"), ("edges",))
def reach2_forward(a: Adapters) -> DataFrame:
    return graph.reach(a.scope.select(F.col("target").alias("seed")), _nodes(a), a.edges, 2)


@query(_REACH + """, pairs AS (SELECT DISTINCT s.target AS src, c.file_path AS dst FROM v_scope s JOIN v_changes c USING (change_set_id))
SELECT src, dst, coalesce(r.distance, -1) AS distance FROM pairs LEFT JOIN reach r ON r.seed = src AND r.path = dst""", ("v_scope", "v_changes", "v_edges"), _KEPT)
def distance_le2(a: Adapters) -> DataFrame:
    pairs = a.scope.join(a.changes, "change_set_id").select(F.col("target").alias("src"), F.col("file_path").alias("dst")).distinct()
    return graph.distance(pairs, _nodes(a), a.edges, 2)


@query("""+r pairs AS (SELECT DISTINCT s.target AS src, c.file_path AS dst FROM v_scope s JOIN v_changes c USING (change_set_id)),
walk(seed, path, distance) AS (SELECT DISTINCT src, src, 0 FROM pairs UNION SELECT seed, e.dst, distance + 1 FROM walk JOIN v_edges e ON e.src = walk.path),
near AS (SELECT seed, path, min(distance) AS distance FROM walk GROUP BY seed, path)
SELECT src, dst, coalesce(distance, -1) AS distance FROM pairs LEFT JOIN near ON seed = src AND path = dst""", ("v_scope", "v_changes", "v_edges"), ("edges",))
def distance_any(a: Adapters) -> DataFrame:
    """Without a bound, from each change set's target to its changes."""
    pairs = a.scope.join(a.changes, "change_set_id").select(F.col("target").alias("src"), F.col("file_path").alias("dst")).distinct()
    return graph.distance(pairs, _nodes(a), a.edges)


DOWN = """+ w0 AS (SELECT change_set_id, ordinal, file_path AS path, [file_path] AS via FROM v_changes),
w1 AS (SELECT change_set_id, ordinal, e.src AS path, min(list_append(via, e.src)) AS via FROM w0 JOIN v_edges e ON e.dst = w0.path GROUP BY ALL),
w2 AS (SELECT change_set_id, ordinal, e.src AS path, min(list_append(via, e.src)) AS via FROM w1 JOIN v_edges e ON e.dst = w1.path GROUP BY ALL),
w3 AS (SELECT change_set_id, ordinal, e.src AS path, min(list_append(via, e.src)) AS via FROM w2 JOIN v_edges e ON e.dst = w2.path GROUP BY ALL),
walks AS (SELECT *, 1 AS distance FROM w1 UNION ALL SELECT *, 2 FROM w2 UNION ALL SELECT *, 3 FROM w3),
cent AS (SELECT dst AS path, count(*) AS n FROM v_edges GROUP BY dst),
impacts AS (SELECT w.change_set_id, w.path AS file_path, w.distance, array_to_string(w.via, '>') AS via,
  round((CASE w.distance WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END) * (0.5::DOUBLE + 0.5::DOUBLE * (coalesce(cent.n, 0)::DOUBLE / greatest(1, (SELECT max(n) FROM cent)))), 6) AS risk
 FROM (SELECT *, row_number() OVER (PARTITION BY change_set_id, path ORDER BY distance, ordinal, via) AS k FROM walks) w LEFT JOIN cent ON cent.path = w.path
 WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM v_changes c WHERE c.change_set_id = w.change_set_id AND c.file_path = w.path))"""


def _impacts(a: Adapters) -> DataFrame:
    return graph.downstream(a.changes, _nodes(a), a.edges)


@query(DOWN + " SELECT change_set_id, file_path, distance, risk FROM impacts", ("v_changes", "v_edges"), _KEPT[::2])
def downstream_impacts(a: Adapters) -> DataFrame:
    return _impacts(a).select("change_set_id", "file_path", "distance", _r(F.col("risk_contribution")).alias("risk"))


@query(DOWN + " SELECT change_set_id, file_path, via FROM impacts", ("v_changes", "v_edges"), _KEPT[::2])
def downstream_min_path(a: Adapters) -> DataFrame:
    return _impacts(a).select("change_set_id", "file_path", F.array_join("via_files", ">").alias("via"))


@query(DOWN + " SELECT i.change_set_id, i.file_path, i.distance, i.risk FROM impacts i WHERE NOT EXISTS (SELECT 1 FROM v_scope s WHERE s.change_set_id = i.change_set_id AND s.target = i.file_path)", ("v_changes", "v_edges", "v_scope"), _KEPT)
def impacts_out_of_scope(a: Adapters) -> DataFrame:
    return graph.downstream(a.changes, _nodes(a), a.edges, scopes=_scopes(a)).select("change_set_id", "file_path", "distance", _r(F.col("risk_contribution")).alias("risk"))


# ---- paths, patterns, languages -----------------------------------------------------------------------------


@query("SELECT change_set_id, file_path FROM v_changes WHERE NOT (starts_with(file_path, 'src/api/') OR starts_with(file_path, 'src/api') OR file_path GLOB '*.lock' OR file_path GLOB 'tests/test_a*')", ("v_changes",))
def ignore_filter(a: Adapters) -> DataFrame:
    return a.changes.filter(~globs.user_ignored(F.col("file_path"), ["src/api/", "*.lock", "tests/test_a*"])).select("change_set_id", "file_path")


#: Patterns of forty projects, made from the names of some of their files: folders, beginnings, ends, parts, sets and whole paths.
_PATTERNS = """SELECT file_id % 40 AS project, file_id AS ordinal, CASE cast(floor(file_id / 40) AS int) % 9 WHEN 0 THEN path WHEN 1 THEN concat(replace(path, '.', '*.'), '*')
 WHEN 2 THEN concat('*', substring(path, length(path) - 7, 8)) WHEN 3 THEN concat('*/', substring(path, 5, 4), '*') WHEN 4 THEN concat(substring(path, 1, 9), '/') WHEN 5 THEN concat('*', substring(path, 6, 3), '*[0-5].?s')
 WHEN 6 THEN concat('?', substring(path, 2, 7), '*') WHEN 7 THEN concat('*[!a-z]', cast(file_id % 100 AS string), '.*') ELSE concat('lib/', substring(path, 5, 3), '*.lock') END AS pattern FROM v_files"""


@query(f"""+ p AS ({_PATTERNS}), f AS (SELECT file_id % 40 AS project, path FROM v_files)
SELECT project, path, ordinal, pattern FROM (SELECT f.project, f.path, p.ordinal, p.pattern, row_number() OVER (PARTITION BY f.project, f.path ORDER BY p.ordinal, p.pattern) AS k FROM f JOIN p ON p.project = f.project
 AND CASE WHEN ends_with(p.pattern, '/') THEN starts_with(f.path, rtrim(p.pattern, '/')) ELSE f.path GLOB p.pattern END) WHERE k = 1""", ("v_files",))
def ignore_by_project(a: Adapters) -> DataFrame:
    """The first of its project's patterns that each file matches."""
    patterns = a.spark.sql(_PATTERNS.replace("v_files", "{v_files}"), v_files=a.files)
    return ignore.first_matches(a.files.select((F.col("file_id") % 40).alias("project"), "path"), patterns)


_CATEGORY = """CASE WHEN file_path LIKE '%.lock' THEN 'lockfiles' WHEN file_path LIKE '%.min.js' THEN 'generated' WHEN concat('/', file_path) LIKE '%/migrations/%' THEN 'migrations' END"""


@query(f"SELECT change_set_id, file_path, {_CATEGORY} AS category FROM v_changes WHERE {_CATEGORY} IS NOT NULL", ("v_changes",))
def auto_ignore_category(a: Adapters) -> DataFrame:
    found = a.changes.select("change_set_id", "file_path", relevance.side_effect(F.col("file_path")).alias("category"))
    return found.filter("category is not null")


@query("SELECT CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'go' END AS language, count(*) AS n FROM v_files WHERE path NOT LIKE '%.lock' GROUP BY 1", ("v_files",))
def language_rank(a: Adapters) -> DataFrame:
    return languages.frequency(a.files)


@query(r"""SELECT path, regexp_replace(string_split(path, '/')[-1], '^(.+)\.[^.]+$', '\1') AS stem, lower(regexp_extract(path, '\.[^.]+$')) AS suffix, regexp_replace(path, '/[^/]+$', '') AS parent FROM v_files""", ("v_files",))
def path_stems(a: Adapters) -> DataFrame:
    p = F.col("path")
    return a.files.select("path", paths.stem(p).alias("stem"), paths.suffix(p).alias("suffix"), paths.parent(p).alias("parent"))


@query(r"SELECT path, regexp_matches(string_split(path, '/')[-1], '^test_|_test\.py$') AS is_test FROM v_files", ("v_files",))
def looks_like_test(a: Adapters) -> DataFrame:
    return a.files.select("path", risk.looks_like_test(F.col("path")).alias("is_test"))


# ---- relevance ---------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in scope.STOP_WORDS) + "]"
_SCORED = rf"""+ c AS (
 SELECT c.*, s.target, s.confidence AS scope_confidence, s.text,
  string_split(regexp_replace(c.file_path, '/[^/]+$', ''), '/') AS d1, string_split(regexp_replace(s.target, '/[^/]+$', ''), '/') AS d2,
  list_distinct(list_transform(string_split(c.file_path, '/'), lambda p: lower(regexp_replace(p, '^(.+)\.[^.]+$', '\1')))) AS stems,
  [lower(regexp_replace(string_split(s.target, '/')[-1], '^(.+)\.[^.]+$', '\1'))] AS target_stems,
  list_filter(regexp_split_to_array(lower(s.text), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)) AS words
 FROM v_changes c JOIN v_scope s USING (change_set_id)),
cent AS (SELECT dst AS path, count(*) AS n FROM v_edges GROUP BY dst),
h1 AS (SELECT DISTINCT s.change_set_id, e.dst AS path FROM v_scope s JOIN v_edges e ON e.src = s.target),
h2 AS (SELECT DISTINCT h1.change_set_id, e.dst AS path FROM h1 JOIN v_edges e ON e.src = h1.path),
hops AS (SELECT change_set_id, path, min(d) AS d FROM (SELECT change_set_id, target AS path, 0 AS d FROM v_scope UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL),
scored AS (SELECT *, 0.4::DOUBLE * explicit + 0.25::DOUBLE * overlap + 0.15::DOUBLE * proximity + 0.2::DOUBLE * chain AS relevance FROM (
 SELECT c.change_set_id, c.ordinal, c.file_path, c.added_lines, c.removed_lines, c.change_type, c.is_new_file, c.is_deleted, c.scope_confidence, c.added_lines + c.removed_lines AS lines,
  (c.file_path = c.target)::INT::DOUBLE AS explicit,
  length(list_intersect(stems, list_concat(words, target_stems)))::DOUBLE / length(stems) AS overlap,
  (CASE WHEN d1[1] <> d2[1] THEN 0 WHEN length(d1) > 1 AND length(d2) > 1 AND d1[2] = d2[2] THEN 2 ELSE 1 END)::DOUBLE / greatest(length(d1), length(d2)) AS proximity,
  (CASE h.d WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.0 END)::DOUBLE AS chain, h.d IS NOT NULL AS linked, coalesce(cent.n, 0) AS centrality,
  {_CATEGORY} AS category,
  (CASE WHEN c.scope_confidence < 0.4 THEN 0.3::DOUBLE * 2 WHEN c.scope_confidence < 0.5 THEN 0.3::DOUBLE * 1.5 ELSE 0.3::DOUBLE END) AS threshold
 FROM c LEFT JOIN hops h ON h.change_set_id = c.change_set_id AND h.path = c.file_path LEFT JOIN cent ON cent.path = c.file_path)),
judged AS (SELECT *,
 CASE WHEN category IS NOT NULL OR lines <= 2 THEN 'info' WHEN relevance < threshold AND lines > 5 AND centrality > 5 THEN 'critical'
      WHEN relevance < threshold OR (relevance < 0.4 AND centrality > 3) THEN 'warning' ELSE 'info' END AS severity,
 CASE WHEN category IS NOT NULL OR lines <= 2 OR linked THEN least(0.4::DOUBLE, greatest(0.1::DOUBLE, relevance))
      WHEN chain = 0 AND overlap = 0 AND lines > 3 THEN 0.9::DOUBLE + least(0.1::DOUBLE, (1.0::DOUBLE - relevance) * 0.2::DOUBLE)
      WHEN overlap > 0 OR chain > 0 THEN 0.5::DOUBLE + least(0.4::DOUBLE, chain * 0.3::DOUBLE) ELSE 0.6::DOUBLE END AS confidence
 FROM scored),
phantoms AS (SELECT *, CASE WHEN category IS NOT NULL THEN 'info' ELSE severity END AS level FROM judged WHERE category IS NOT NULL OR (relevance < threshold AND NOT linked))"""
REASON = """CASE category WHEN 'lockfiles' THEN 'Dependency lockfiles auto-update when packages change' WHEN 'generated' THEN 'Auto-generated files change as a side effect of source changes'
  WHEN 'migrations' THEN 'Database migrations are expected side effects of model changes'
  ELSE concat(CASE WHEN explicit = 0 THEN 'not in scope target files; ' ELSE '' END, CASE WHEN overlap = 0 THEN 'no' ELSE 'partial' END, ' path overlap with scope; ',
   CASE WHEN chain = 0 THEN 'no import-chain connection to scope' ELSE 'weak import-chain connection' END, '; relevance=', format('{:.2f}', relevance)) END"""
_RV = ("v_changes", "v_scope", "v_edges")


def _scored(a: Adapters) -> DataFrame:
    return relevance.scored(_changes(a), _scopes(a), _nodes(a), a.edges)


def _part(name: str) -> Callable[[Adapters], DataFrame]:
    return lambda a: settled(_scored(a).select("change_set_id", "file_path", _r(F.col(name)).alias(name)), "change_set_id", True)


for _name, _column in (("explicit_match", "explicit"), ("path_match", "overlap"), ("proximity", "proximity"), ("import_chain", "chain"), ("relevance", "relevance"), ("effective_threshold", "threshold"), ("phantom_confidence", "confidence")):
    _build = _part(_column)
    _build.__name__ = _name
    query(_SCORED + f" SELECT change_set_id, file_path, round({_column}, 6) AS {_column} FROM judged", _RV, _KEPT)(_build)


@query(_SCORED + " SELECT change_set_id, file_path, severity FROM judged", _RV, _KEPT)
def phantom_severity(a: Adapters) -> DataFrame:
    return settled(_scored(a).select("change_set_id", "file_path", "severity"), "change_set_id", True)


def _judged(a: Adapters) -> DataFrame:
    return settled(_scored(a).select(*relevance.JUDGED), "change_set_id", True)  # else what reads them works the scores out again


def _phantoms(a: Adapters) -> DataFrame:
    return relevance.phantoms(_judged(a))


@query(_SCORED + """ SELECT change_set_id, file_path, level AS severity, round(confidence, 6) AS confidence, round(relevance, 6) AS relevance_score,
 concat(CASE WHEN is_new_file THEN 'New file' WHEN is_deleted THEN 'Deleted file' ELSE 'Modified' END, ' ', file_path, ' [+', added_lines, '/-', removed_lines, ']') AS change_summary,
 """ + REASON + """ AS reason FROM phantoms""", _RV, _KEPT)
def phantoms(a: Adapters) -> DataFrame:
    return _phantoms(a).select("change_set_id", "file_path", "severity", _r(F.col("confidence")).alias("confidence"), _r(F.col("relevance_score")).alias("relevance_score"), "change_summary", "reason")


# ---- risk --------------------------------------------------------------------------------------------------

RISK = _SCORED + """, total AS (SELECT change_set_id, sum(added_lines + removed_lines) AS lines, sum(removed_lines) AS removed, count(*) AS n FROM v_changes GROUP BY 1),
outside AS (SELECT change_set_id, sum(lines) AS lines FROM phantoms GROUP BY 1),
cf AS (SELECT change_set_id, sum(coalesce(cent.n, 0)) AS s, max(coalesce(cent.n, 0)) AS m, count(*) AS n FROM v_changes v LEFT JOIN cent ON cent.path = v.file_path GROUP BY 1),
named AS (SELECT change_set_id, ordinal, file_path, regexp_replace(string_split(file_path, '/')[-1], '\\.[^.]*$', '') AS base, regexp_replace(file_path, '/[^/]+$', '') AS folder FROM v_changes),
cov AS (SELECT change_set_id, 1.0::DOUBLE - sum(CASE WHEN EXISTS (SELECT 1 FROM v_changes t WHERE t.change_set_id = n.change_set_id AND (regexp_matches(t.file_path, '(^|/)test_[^/]*$|_test\\.py$'))
   AND t.file_path IN (n.file_path, concat(n.folder, '/test_', n.base, '.py'), concat('tests/test_', n.base, '.py'), concat('test/', n.base, '_test.py'))) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS test_coverage FROM named n GROUP BY 1),
factors AS (SELECT t.change_set_id, s.confidence,
  CASE WHEN s.confidence < 0.3 OR t.lines = 0 THEN 0.0 ELSE least(1.0::DOUBLE, coalesce(o.lines, 0)::DOUBLE / t.lines) END::DOUBLE AS scope_overflow,
  least(1.0::DOUBLE, t.lines::DOUBLE / 500) AS complexity, CASE WHEN cf.m = 0 THEN 0.0 ELSE cf.s::DOUBLE / (cf.m * cf.n) END::DOUBLE AS centrality, cov.test_coverage,
  CASE WHEN t.lines = 0 THEN 0.0 ELSE t.removed::DOUBLE / t.lines END::DOUBLE AS deletion
 FROM total t JOIN v_scope s USING (change_set_id) JOIN cf USING (change_set_id) JOIN cov USING (change_set_id) LEFT JOIN outside o USING (change_set_id)),
risk AS (SELECT *, 0.3::DOUBLE * scope_overflow + 0.2::DOUBLE * complexity + 0.2::DOUBLE * centrality + 0.15::DOUBLE * test_coverage + 0.15::DOUBLE * deletion AS risk_score FROM factors),
classed AS (SELECT *, CASE WHEN confidence < 0.4 AND risk_score >= 0.6 THEN 'review' WHEN risk_score < 0.3 THEN 'safe' WHEN risk_score < 0.6 THEN 'review' ELSE 'danger' END AS risk_level FROM risk)"""


def _risk(a: Adapters) -> DataFrame:
    judged = _judged(a)
    return settled(risk.risk(judged, _scopes(a), relevance.phantoms(judged), a.edges, fail_on="review"), "change_set_id", True)


def _factor(build: Callable[[Adapters], DataFrame], column: str) -> Callable[[Adapters], DataFrame]:
    return lambda a: build(a).select("change_set_id", _r(F.col(column)).alias(column))


for _name, _column, _source in (
    ("factor_scope_overflow", "scope_overflow", lambda a: risk.scope_overflow(_changes(a), _scopes(a), _phantoms(a))),
    ("factor_complexity", "complexity", lambda a: risk.line_factors(a.changes)),
    ("factor_deletion", "deletion", lambda a: risk.line_factors(a.changes)),
    ("factor_centrality", "centrality", lambda a: risk.centrality_factor(a.changes, a.edges)),
    ("factor_test_coverage", "test_coverage", lambda a: risk.test_coverage(a.changes)),
    ("risk_score", "risk_score", _risk),
):
    _build = _factor(_source, _column)
    _build.__name__ = _name
    query(RISK + f" SELECT change_set_id, round({_column}, 6) AS {_column} FROM classed", _RV, _KEPT)(_build)


@query(RISK + " SELECT change_set_id, risk_level FROM classed", _RV, _KEPT)
def risk_class(a: Adapters) -> DataFrame:
    return _risk(a).select("change_set_id", "risk_level")


@query(RISK + " SELECT change_set_id, CASE WHEN confidence < 0.4 THEN 0 WHEN risk_level IN ('review', 'danger') THEN 1 ELSE 0 END AS exit_code FROM classed", _RV, _KEPT)
def exit_code(a: Adapters) -> DataFrame:
    return _risk(a).select("change_set_id", "exit_code")


# ---- scope -------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT change_set_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))) AS keyword FROM v_scope", ("v_scope",))
def keywords(a: Adapters) -> DataFrame:
    # the words of a change set come together as one row, which is told apart sooner than each of them
    words = a.scope.select("change_set_id", F.array_distinct(scope.keywords(F.col("text"))).alias("words"))
    return words.groupBy("change_set_id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")).select("change_set_id", F.explode("words").alias("keyword"))


_INPUTS = """SELECT change_set_id, CASE WHEN change_set_id % 4 = 0 THEN text ELSE ' ' END AS prompt, CASE WHEN change_set_id % 3 = 0 THEN text END AS cli_scope, m.message AS head_message FROM v_scope JOIN v_messages m USING (change_set_id)"""


@query(f"""+ i AS ({_INPUTS}) SELECT change_set_id, CASE WHEN trim(prompt) <> '' THEN prompt WHEN trim(coalesce(cli_scope, '')) <> '' THEN cli_scope ELSE head_message END AS text,
 (CASE WHEN trim(prompt) <> '' THEN 1.0 WHEN trim(coalesce(cli_scope, '')) <> '' THEN 0.8 ELSE 0.6 END)::DOUBLE AS confidence,
 CASE WHEN trim(prompt) <> '' THEN 'prompt_file' WHEN trim(coalesce(cli_scope, '')) <> '' THEN 'cli' ELSE 'commit_message' END AS source
 FROM i WHERE trim(prompt) <> '' OR trim(coalesce(cli_scope, '')) <> '' OR trim(head_message) <> ''""", ("v_scope", "v_messages"))
def scope_priority(a: Adapters) -> DataFrame:
    key = F.col("change_set_id")
    inputs = a.scope.join(a.messages, "change_set_id").select("change_set_id", F.when(key % 4 == 0, F.col("text")).otherwise(" ").alias("prompt"), F.when(key % 3 == 0, F.col("text")).alias("cli_scope"), F.col("message").alias("head_message"))
    return scope.resolve(inputs)


@query("""SELECT change_set_id, directory FROM (SELECT change_set_id, directory, row_number() OVER (PARTITION BY change_set_id ORDER BY n DESC, first) AS k
 FROM (SELECT change_set_id, regexp_replace(file_path, '/[^/]+$', '') AS directory, count(*) AS n, min(ordinal) AS first FROM v_changes GROUP BY 1, 2)) WHERE k = 1""", ("v_changes",))
def scope_dominant_dir(a: Adapters) -> DataFrame:
    return scope.dominant_directory(a.changes)


@query(rf"""+ words AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))) AS keyword FROM v_scope)
SELECT DISTINCT w.keyword, f.path FROM words w JOIN v_files f ON lower(regexp_replace(string_split(f.path, '/')[-1], '^(.+)\.[^.]+$', '\1')) = w.keyword
 OR (regexp_matches(f.path, '\.(py|js|ts|go)$') AND list_contains(string_split(regexp_replace(f.path, '/[^/]+$', ''), '/'), w.keyword))""", ("v_scope", "v_files"))
def keyword_to_files(a: Adapters) -> DataFrame:
    """The files that each keyword of any scope stands for."""
    words = a.scope.select(F.explode(scope.keywords(F.col("text"))).alias("keyword")).distinct()
    found = scope.keyword_files(words.select(F.col("keyword").alias("change_set_id"), "keyword"), a.files)
    return found.withColumnRenamed("change_set_id", "keyword")


@query("""SELECT change_set_id, list_sort(list_distinct(list_concat([target], CASE WHEN contains(lower(text), 'auth') THEN ['src/auth/extra.py'] ELSE [] END, CASE WHEN contains(lower(text), 'red') THEN ['docs/red.md', 'src/red.py'] ELSE [] END)))::VARCHAR AS files FROM v_scope""", ("v_scope",))
def area_enrichment(a: Adapters) -> DataFrame:
    areas = a.spark.createDataFrame([("auth", "files", "src/auth/extra.py"), ("Red", "files", "src/red.py"), ("Red", "related", "docs/red.md")], "area string, kind string, path string")
    enriched = scope.enrich(_scopes(a), areas)
    return enriched.select("change_set_id", F.concat(F.lit("["), F.array_join("target_files", ", "), F.lit("]")).alias("files"))


@query("""+ areas AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS area, concat('docs/', p_brand, '/', p_size, '.md') AS path FROM part),
hits AS (SELECT change_set_id, list(DISTINCT a.path) AS paths FROM v_scope s JOIN areas a ON contains(lower(s.text), a.area) GROUP BY change_set_id)
SELECT change_set_id, array_to_string(list_sort(list_distinct(list_append(coalesce(paths, []), target))), ',') AS files FROM v_scope LEFT JOIN hits USING (change_set_id)""", ("v_scope",))
def area_files(a: Adapters) -> DataFrame:
    """The files of areas named after the second words of parts' names, for each scope that mentions one."""
    parts = a.table("part")
    areas = parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("area"), F.lit("files").alias("kind"), F.concat(F.lit("docs/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".md")).alias("path"))
    return scope.enrich(_scopes(a), areas).select("change_set_id", F.array_join("target_files", ",").alias("files"))


_FILES = scope.FILES.removeprefix("(?U)")


@query(rf"""+ t AS (SELECT change_set_id, concat(text, ' via run_', change_set_id % 5, '() and load()') AS text FROM v_scope)
SELECT change_set_id, text AS description, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_FILES}'))), ',') AS files,
 array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b([a-zA-Z_]\w*)\s*\(\)', 1))), ',') AS functions,
 array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)))), ',') AS concepts FROM t""", ("v_scope",))
def scope_parsed(a: Adapters) -> DataFrame:
    text = F.concat("text", F.lit(" via run_"), (F.col("change_set_id") % 5).cast("string"), F.lit("() and load()"))
    found = scope.parse(a.scope.select("change_set_id", text.alias("text"), "confidence", F.lit("cli").alias("source")))
    return found.select("change_set_id", "description", *(F.array_join(f"target_{x}", ",").alias(x) for x in ("files", "functions", "concepts")))


@query(rf"""+ f AS (SELECT DISTINCT change_set_id, unnest(list_transform(string_split(file_path, '/'), lambda p: regexp_replace(p, '^(.+)\.[^.]+$', '\1'))) AS stem FROM v_changes),
d AS (SELECT change_set_id, regexp_replace(file_path, '/[^/]+$', '') AS directory, count(*) AS n, min(ordinal) AS first FROM v_changes GROUP BY 1, 2)
SELECT change_set_id, concat('Changes concentrated in ', arg_max(directory, n * 1000000 - first)) AS description,
 (SELECT string_agg(DISTINCT lower(stem), ',' ORDER BY lower(stem)) FROM f WHERE f.change_set_id = d.change_set_id AND NOT list_contains({_STOP}, stem)) AS concepts,
 (SELECT string_agg(file_path, ',' ORDER BY file_path) FROM v_changes v WHERE v.change_set_id = d.change_set_id) AS files FROM d GROUP BY change_set_id""", ("v_changes",), ("changes",))
def scope_inferred(a: Adapters) -> DataFrame:
    found = scope.infer(_changes(a))
    return found.select("change_set_id", "description", F.array_join("target_concepts", ",").alias("concepts"), F.array_join("target_files", ",").alias("files"))


# ---- commit messages ---------------------------------------------------------------------------------------

_VAGUE = ", ".join(f"'{w}'" for w in commits.VAGUE)
QUALITY = rf"""+ w AS (SELECT DISTINCT change_set_id, word FROM (
  SELECT change_set_id, lower(regexp_replace(string_split(file_path, '/')[-1], '^(.+)\.[^.]+$', '\1')) AS word FROM v_changes
  UNION ALL SELECT change_set_id, word FROM (SELECT change_set_id, unnest(list_transform(string_split(file_path, '/'), lambda p: rtrim(rtrim(rtrim(lower(p), '.py'), '.js'), '.ts'))) AS word FROM v_changes) WHERE length(word) > 2)),
hit AS (SELECT DISTINCT m.change_set_id FROM (SELECT change_set_id, unnest(regexp_extract_all(lower(message), '[a-z_]+')) AS word FROM v_messages) m JOIN w USING (change_set_id, word)),
q AS (SELECT m.change_set_id, m.message, m.message IN ({_VAGUE}) AS vague, length(m.message) < 10 AS short, c.change_set_id IS NOT NULL AND hit.change_set_id IS NULL AS stray, m.message LIKE 'feat(%' AS conventional
 FROM v_messages m LEFT JOIN (SELECT DISTINCT change_set_id FROM v_changes) c USING (change_set_id) LEFT JOIN hit USING (change_set_id)),
scored AS (SELECT *, CASE WHEN message = '' THEN 0.0::DOUBLE WHEN conventional THEN least(1.0::DOUBLE, base + 0.1::DOUBLE) ELSE greatest(0.0::DOUBLE, base - 0.1::DOUBLE) END AS score
 FROM (SELECT *, 1.0::DOUBLE - (CASE WHEN vague THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN short THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN stray THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS base FROM q))"""


@query(QUALITY + """ SELECT change_set_id, round(score, 2) AS score, vague OR message = '' AS is_vague,
 CASE WHEN message = '' THEN 1 ELSE vague::INT + short::INT + stray::INT + (NOT conventional)::INT END AS issues FROM scored""", ("v_changes", "v_messages"), ("changes",))
def commit_quality(a: Adapters) -> DataFrame:
    rows = commits.quality(a.messages, _changes(a))
    return rows.select("change_set_id", _r(F.col("score")).alias("score"), "is_vague", F.size("issues").alias("issues"))


@query(r"""+ g AS (SELECT change_set_id, count(*) AS n, list_distinct(list(change_type)) AS kinds, list(regexp_replace(string_split(file_path, '/')[-1], '^(.+)\.[^.]+$', '\1') ORDER BY ordinal) AS stems,
 min(string_split(file_path, '/')) AS lo, max(string_split(file_path, '/')) AS hi, min(length(string_split(file_path, '/'))) AS short, max(length(string_split(file_path, '/'))) AS long FROM v_changes GROUP BY 1),
s AS (SELECT *, CASE WHEN n = 1 THEN stems[1] WHEN lo[1] <> hi[1] THEN '' WHEN lo[2] <> hi[2] OR length(lo) = 2 OR length(hi) = 2 THEN lo[1] ELSE lo[2] END AS scope,
 CASE WHEN kinds = ['added'] THEN 'feat' WHEN kinds = ['deleted'] THEN 'refactor' ELSE 'fix' END AS kind FROM g)
SELECT change_set_id, concat(kind, CASE WHEN scope = '' THEN '' ELSE concat('(', scope, ')') END, ': update ', CASE WHEN n <= 3 THEN array_to_string(stems, ', ') ELSE concat(n, ' files in ', CASE WHEN scope = '' THEN 'project' ELSE scope END) END) AS suggestion FROM s""", ("v_changes",))
def commit_suggestion(a: Adapters) -> DataFrame:
    return commits.suggestions(_changes(a)).select("change_set_id", "suggestion")


# ---- tests -------------------------------------------------------------------------------------------------

_STEM = r"regexp_replace(string_split({0}, '/')[-1], '^(.+)\.[^.]+$', '\1')"
TESTS = r"""+ c AS (SELECT change_set_id, ordinal, file_path, is_deleted FROM v_changes),
byimport AS (SELECT change_set_id, ordinal, file_path AS changed_file, e.src AS test_file FROM c JOIN v_edges e ON e.dst = c.file_path WHERE regexp_matches(e.src, '/test_[^/]*\.py$')),
best AS (SELECT change_set_id, test_file, changed_file, 0.8::DOUBLE AS confidence FROM (SELECT x.*, row_number() OVER (PARTITION BY x.change_set_id, test_file ORDER BY x.ordinal) AS k
 FROM byimport x JOIN c ON c.change_set_id = x.change_set_id AND c.ordinal = x.ordinal WHERE NOT c.is_deleted) WHERE k = 1)"""
_TV = ("v_files", "v_changes", "v_edges")


@query(f"""SELECT change_set_id, file_path AS changed_file, concat('tests/test_', {_STEM.format('path')}, '.py') AS test_file
FROM v_changes JOIN v_files ON path = file_path WHERE path LIKE '%.py'""", ("v_files", "v_changes"))
def tests_by_name(a: Adapters) -> DataFrame:
    """With a test for each Python file, named after it."""
    made = a.files.filter("path like '%.py'").select(F.concat(F.lit("tests/test_"), paths.stem(F.col("path")), F.lit(".py")).alias("path"))
    found = test_mapping.by_name(_changes(a), test_mapping.test_files(made))
    return found.select("change_set_id", "changed_file", "test_file").join(a.files.select(F.col("path").alias("changed_file")).filter("changed_file like '%.py'"), "changed_file", "left_semi")


@query(rf"""+ f AS (SELECT file_id, path, string_split(path, '/')[2] AS folder, {_STEM.format("path")} AS stem FROM v_files WHERE path LIKE 'src/%/%')
SELECT c.path AS changed_file, concat('tests/', substr(t.path, 5)) AS test_file FROM f c JOIN f t USING (folder)
WHERE regexp_matches(t.path, '\.(ts|py)$') AND regexp_replace(regexp_replace(t.stem, '^test[_-]', ''), '[_-]test$', '') <> c.stem""", ("v_files",))
def tests_by_dir(a: Adapters) -> DataFrame:
    """Each file in src/<d>/ as a change seen from within src; the .ts and .py files there moved to tests/<d>/ as tests."""
    inner = a.files.filter("path like 'src/%/%'").withColumn("inner", F.expr("substring(path, 5)"))
    changes = inner.select(F.col("file_id").alias("change_set_id"), F.lit(1).alias("ordinal"), F.col("inner").alias("file_path"))
    moved = inner.filter(r"path rlike '\\.(ts|py)$'").select(F.concat(F.lit("tests/"), "inner").alias("path"))
    found = test_mapping.by_directory(changes, test_mapping.test_files(moved, patterns=("*.ts", "*.py")))
    return found.select(F.concat(F.lit("src/"), "changed_file").alias("changed_file"), "test_file")


@query(TESTS + " SELECT change_set_id, changed_file, test_file FROM byimport", _TV)
def tests_by_import(a: Adapters) -> DataFrame:
    return test_mapping.by_import(_changes(a), a.edges).select("change_set_id", "changed_file", "test_file")


@query("""SELECT c.change_set_id, c.file_path AS changed_file, t.path AS test_file, concat('f', c.file_id % 50) AS function
FROM v_changes c JOIN v_files t ON t.path LIKE 'tests/test_%.py' AND t.file_id % 50 = c.file_id % 50""", ("v_changes", "v_files"), ("changes",))
def tests_by_function(a: Adapters) -> DataFrame:
    """Each change of a function that the tests of some files name."""
    name = F.concat(F.lit("f"), (F.col("file_id") % 50).cast("string"))
    tests = test_mapping.test_files(a.files.withColumn("source", F.concat(F.lit("def test_"), name, F.lit("(): pass"))))
    found = test_mapping.by_function(a.changes.withColumn("functions_modified", F.array(name)), tests)
    return found.select("change_set_id", "changed_file", "test_file", "function")


@query(TESTS + " SELECT change_set_id, test_file, changed_file, confidence FROM best", _TV, ("changes",))
def best_test(a: Adapters) -> DataFrame:
    return test_mapping.suggest(_changes(a), _nodes(a), a.edges).select("change_set_id", "test_file", "changed_file", "confidence")


@query(TESTS + " SELECT change_set_id, concat('pytest ', string_agg(test_file, ' ' ORDER BY test_file), ' -v') AS command FROM best GROUP BY 1", _TV, ("changes",))
def test_command(a: Adapters) -> DataFrame:
    return test_mapping.command(test_mapping.suggest(_changes(a), _nodes(a), a.edges))


# ---- pages -------------------------------------------------------------------------------------------------


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages""")
def page_links(a: Adapters) -> DataFrame:
    return a.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


# ---- references --------------------------------------------------------------------------------------------

_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all(text, '{references.WORD}')) AS name FROM conversations WHERE role = 'user'"


@query(rf"""WITH names AS ({_WORDS}), held AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{references.WORD}')) AS name FROM documents)
SELECT name, doc_id FROM names JOIN held USING (name) WHERE length(name) >= 8""")
def references_of_names(a: Adapters) -> DataFrame:
    """The documents that mention each longer word of what users said."""
    said = a.table("conversations").filter("role = 'user'").select(F.explode(F.regexp_extract_all("text", F.lit(references.WORD), F.lit(0))).alias("name"))
    entries = references.index(a.table("documents"), "doc_id", "text")
    return references.lookup(entries, said.filter("length(name) >= 8").distinct(), key="doc_id")


# ---- sources and reports -----------------------------------------------------------------------------------


@query("""SELECT change_set_id, file_path, added_lines, removed_lines, change_type, is_new_file, is_deleted,
 CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.js' THEN 'javascript' WHEN file_path LIKE '%.ts' THEN 'typescript' WHEN file_path LIKE '%.go' THEN 'go' ELSE 'unknown' END AS language,
 'f' || ordinal AS functions, 'mod.m' || ordinal AS imports FROM v_changes""", ("v_changes",))
def diff_roundtrip(a: Adapters) -> DataFrame:
    """The changes written as diffs and parsed again."""
    kind = F.col("change_type")
    gone, new = kind == "deleted", kind == "added"
    p, n = F.col("file_path"), F.col("ordinal").cast("string")
    text = F.concat(
        F.lit("diff --git a/"), p, F.lit(" b/"), p, F.when(new, "\nnew file mode 100644").when(gone, "\ndeleted file mode 100644").otherwise(""),
        F.lit("\n--- "), F.when(new, "/dev/null").otherwise(F.concat(F.lit("a/"), p)), F.lit("\n+++ "), F.when(gone, "/dev/null").otherwise(F.concat(F.lit("b/"), p)),
        F.lit("\n@@ -1,9 +1 @@ def f"), n, F.lit("(x):\n"), F.repeat(F.lit("-old\n"), F.col("removed_lines").cast("int")),
        F.lit("+from mod import m"), n, F.lit("\n"), F.repeat(F.lit("+new\n"), (F.col("added_lines") - 1).cast("int")),
    )
    texts = a.changes.select("change_set_id", "ordinal", text.alias("text")).groupBy("change_set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("diff_text"))
    found = diffs.parse(texts)
    return found.select("change_set_id", "file_path", "added_lines", "removed_lines", "change_type", "is_new_file", "is_deleted", "language", F.array_join("functions_modified", ",").alias("functions"), F.array_join("imports_modified", ",").alias("imports"))


def _sources(a: Adapters) -> DataFrame:
    """Source texts that import as the edges say: Python by module, JavaScript and TypeScript by relative path."""
    src, dst = F.col("src"), F.col("dst")
    up = F.concat(F.repeat(F.lit("../"), F.size(paths.parent_parts(src))), dst)
    line = F.when(src.endswith(".py"), F.concat(F.lit("from "), F.replace(F.regexp_replace(dst, r"\.[a-z.]+$", ""), F.lit("/"), F.lit(".")), F.lit(" import x"))).otherwise(F.concat(F.lit("import x from './"), up, F.lit("';")))
    lines = a.edges.select(src.alias("path"), line.alias("line")).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("head"))
    body = F.concat(F.coalesce("head", F.lit("")), F.lit("\n\ndef outer(a):\n    def inner():\n        return os.path.join(a)\n    return inner()\n"))
    return a.files.join(lines, "path", "left").select("path", body.alias("source"))


@query(r"SELECT src, dst FROM v_edges WHERE (src LIKE '%.py' AND dst LIKE '%.py') OR regexp_matches(src, '\.(js|ts)$')", ("v_edges",))
def import_graph(a: Adapters) -> DataFrame:
    """The edges again, from the imports of the source texts."""
    return project.edges(_sources(a).withColumn("source", F.when(F.expr(r"path rlike '\\.(py|js|ts)$'"), F.col("source")).otherwise("")))


@query("""SELECT path, f.name, CAST(e.n + f.first AS INT) AS start_line, CAST(e.n + f.last AS INT) AS end_line FROM
 (SELECT path, greatest(count(src), 1) AS n FROM v_files LEFT JOIN v_edges ON src = path WHERE path LIKE '%.py' GROUP BY path) e,
 (VALUES ('outer', 2, 5), ('inner', 3, 4)) f(name, first, last)""", ("v_files", "v_edges"))
def ast_functions(a: Adapters) -> DataFrame:
    found = project.python_sources(_sources(a).filter("path like '%.py'"))
    return found.select("path", F.explode("functions").alias("f")).select("path", "f.*")


@query("""+ e AS (SELECT path, greatest(count(src), 1) AS n FROM v_files LEFT JOIN v_edges ON src = path WHERE path LIKE '%.py' GROUP BY path)
SELECT path, CAST(n + x.d AS INT) AS line, x.name FROM e, (VALUES (2, 'outer'), (3, 'inner'), (4, 'inner'), (5, 'outer')) x(d, name)""", ("v_files", "v_edges"))
def line_to_scope(a: Adapters) -> DataFrame:
    sources = _sources(a).filter("path like '%.py'")
    lines = sources.select("path", F.posexplode(F.split("source", "\n")).alias("line", "text")).select("path", (F.col("line") + 1).alias("line"))
    found = project.python_sources(sources).select("path", F.explode("functions").alias("f")).select("path", "f.*")
    return project.innermost(lines, found)


#: A source for each of several languages, {0} being a number, with the imports and the function (its line and name) in it.
_SAMPLES = (
    ("go", 'import (\n\t"fmt{0}"\n)\nimport "net"\nfunc (s *T) Run{0}(x int) {{', ("fmt{0}", "net"), (5, "Run{0}")),
    ("rs", "use a::b{0};\nextern crate k;\npub fn go{0}(x) {{", ("a::b{0}", "k"), (3, "go{0}")),
    ("java", "import static a.b{0};\nimport c.D;\n  public static int run{0}(int x) {{", ("a.b{0}", "c.D"), (3, "run{0}")),
    ("rb", "require 'x{0}'\nrequire_relative \"y\"\ndef go{0}?\n", ("x{0}", "y"), (3, "go{0}?")),
    ("c", '#include "h{0}.h"\n#include <stdio.h>\n', ("h{0}.h", "stdio.h"), None),
    ("mjs", "import a from 'm{0}';\nconst go{0} = (x) => x;\nexport b from \"n\"", ("m{0}", "n"), (2, "go{0}")),
    ("php", "use A{0};\n  function run{0}() {{\nrequire('z');", ("A{0}", "z"), (2, "run{0}")),
)
_SAMPLED = ", ".join(f"({k}, '{e}')" for k, (e, *_) in enumerate(_SAMPLES))


def _samples(a: Adapters) -> DataFrame:
    made, number = None, F.col("file_id").cast("string")
    for k, (ending, text, _, _) in enumerate(_SAMPLES):
        one = F.struct(F.concat(F.lit("f"), number, F.lit(f".{ending}")).alias("path"), F.replace(F.lit(text.replace("{{", "{")), F.lit("{0}"), number).alias("source"))
        made = F.when(F.col("file_id") % len(_SAMPLES) == k, one) if made is None else made.when(F.col("file_id") % len(_SAMPLES) == k, one)
    return a.files.select(made.alias("f")).select("f.*")


@query(f"""SELECT concat('f', file_id, '.', ending) AS path, replace(name, '{{0}}', file_id::VARCHAR) AS name FROM v_files JOIN (VALUES {", ".join(f"({k}, '{e}', '{n}')" for k, (e, _, names, _) in enumerate(_SAMPLES) for n in names)}) s(k, ending, name) ON file_id % {len(_SAMPLES)} = k""", ("v_files",))
def imports_by_language(a: Adapters) -> DataFrame:
    return project.imports(_samples(a)).select("path", "name")


@query(f"""SELECT concat('f', file_id, '.', ending) AS path, replace(name, '{{0}}', file_id::VARCHAR) AS name, line AS start_line FROM v_files JOIN (VALUES {", ".join(f"({k}, '{e}', {f[0]}, '{f[1]}')" for k, (e, _, _, f) in enumerate(_SAMPLES) if f)}) s(k, ending, line, name) ON file_id % {len(_SAMPLES)} = k""", ("v_files",))
def functions_by_form(a: Adapters) -> DataFrame:
    return project.regex_functions(_samples(a)).select("path", "name", "start_line")


_STARTS = "SELECT path, 'f1' AS name, 2 AS start_line FROM v_files UNION ALL SELECT path, 'f2', CAST(3 + file_id % 3 AS INT) FROM v_files UNION ALL SELECT path, 'f3', 9 FROM v_files"


@query(f"+ s AS ({_STARTS}), l AS (SELECT path, CAST(line AS INT) AS line FROM v_files, range(1, 11) r(line)) SELECT l.path, l.line, s.name FROM l ASOF JOIN s ON l.path = s.path AND l.line >= s.start_line", ("v_files",))
def line_to_preceding(a: Adapters) -> DataFrame:
    starts = a.spark.sql(_STARTS.replace("v_files", "{v_files}"), v_files=a.files)
    lines = a.files.select("path", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("line"))
    return project.preceding(lines, starts)


#: Spans of each file, nested, equal, crossing and one in a row, by its number; and the lines that are asked for.
_SPANS = """SELECT path, concat('s', k) AS name, CAST(1 + (file_id * (k + 3) + k * k) % 97 AS INT) AS start_line,
 CAST(1 + (file_id * (k + 3) + k * k) % 97 + (CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN (file_id + k) % 11 ELSE (file_id * k) % 60 END) AS INT) AS end_line FROM v_files, {numbers}"""
_ASKED = "SELECT path, CAST(line AS INT) AS line FROM v_files, {numbers}"


def _numbered(a: Adapters, text: str, name: str, least: int, most: int) -> DataFrame:
    return a.spark.sql(text.replace("{numbers}", f"(SELECT id AS {name} FROM range({least}, {most}))").replace("v_files", "{v_files}"), v_files=a.files)


@query(f"""+ s AS ({_SPANS.format(numbers="range(0, 12) r(k)")}), l AS ({_ASKED.format(numbers="range(1, 161) r(line)")})
SELECT path, line, name FROM (SELECT l.path, l.line, s.name, row_number() OVER (PARTITION BY l.path, l.line ORDER BY s.end_line - s.start_line, s.start_line, s.name) AS k
 FROM l JOIN s ON l.path = s.path AND l.line BETWEEN s.start_line AND s.end_line) WHERE k = 1""", ("v_files",))
def line_to_narrowest(a: Adapters) -> DataFrame:
    """The narrowest of twelve nested, equal and crossing spans around each of 160 lines of every file."""
    return project.innermost(_numbered(a, _ASKED, "line", 1, 161), _numbered(a, _SPANS, "k", 0, 12))


@query(f"""+ s AS (SELECT path, min(name) AS name, start_line FROM ({_SPANS.format(numbers="range(0, 12) r(k)")}) GROUP BY path, start_line), l AS ({_ASKED.format(numbers="range(1, 161) r(line)")})
SELECT l.path, l.line, s.name FROM l ASOF JOIN s ON l.path = s.path AND l.line >= s.start_line""", ("v_files",))
def line_to_last_start(a: Adapters) -> DataFrame:
    """The last of twelve starts, some of them on one line, at or before each of 160 lines of every file."""
    return project.preceding(_numbered(a, _ASKED, "line", 1, 161), _numbered(a, _SPANS, "k", 0, 12).drop("end_line"))


@query("SELECT path, concat('K', file_id) AS class, 1 AS start_line, 4 AS end_line, 'print,self.g.h' AS calls, 'f,g' AS touched FROM v_files WHERE path LIKE '%.py'", ("v_files",))
def ast_classes_and_calls(a: Adapters) -> DataFrame:
    body = F.concat(F.lit("class K"), F.col("file_id").cast("string"), F.lit(":\n    def f(self): print(1)\n    def g(self):\n        return self.g.h(1)\n"))
    found = project.python_sources(a.files.filter("path like '%.py'").select("path", body.alias("source")))
    lines = found.select("path", F.explode(F.array(F.lit(2), F.lit(4), F.lit(3))).alias("line"))
    touched = project.touched(lines, found.select("path", F.explode("functions").alias("f")).select("path", "f.*"))
    one = found.select("path", "calls", F.explode("classes").alias("k")).join(touched, "path")
    return one.select("path", F.col("k.name").alias("class"), "k.start_line", "k.end_line", F.array_join("calls", ",").alias("calls"), F.array_join("functions", ",").alias("touched"))


@query("""SELECT change_set_id, file_path, 'renamed' AS change_type, concat('old/', file_path) AS old_path, concat('1,2,', ordinal, ',1 def f', ordinal, '|10,1,11,1 class K:') AS hunks, concat('f', ordinal, ',K') AS functions
FROM v_changes WHERE change_type = 'modified'""", ("v_changes",))
def diff_renames_and_hunks(a: Adapters) -> DataFrame:
    """Modified files as renamed ones with two hunks each, written as diffs and parsed again."""
    p, n = F.col("file_path"), F.col("ordinal").cast("string")
    text = F.concat(
        F.lit("diff --git a/old/"), p, F.lit(" b/"), p, F.lit("\nsimilarity index 90%\nrename from old/"), p, F.lit("\nrename to "), p, F.lit("\n--- a/old/"), p, F.lit("\n+++ b/"), p,
        F.lit("\n@@ -1,2 +"), n, F.lit(",1 @@ def f"), n, F.lit("\n-old\n same\n@@ -10 +11 @@ class K:\n+new\n"),
    )
    texts = a.changes.filter("change_type = 'modified'").select(F.concat_ws("/", "change_set_id", "ordinal").alias("change_set_id"), text.alias("diff_text"))
    found = diffs.parse(texts)
    said = F.transform("hunks", lambda h: F.format_string("%d,%d,%d,%d %s", h["old_start"], h["old_count"], h["new_start"], h["new_count"], h["function_header"]))
    key = F.split("change_set_id", "/")[0].cast("long").alias("change_set_id")
    return found.select(key, "file_path", "change_type", "old_path", F.array_join(said, "|").alias("hunks"), F.array_join("functions_modified", ",").alias("functions"))


@query("""SELECT path, CASE WHEN file_id % 7 = 0 THEN 'added' WHEN file_id % 7 = 1 THEN 'removed' ELSE 'modified' END AS state FROM v_files WHERE file_id % 7 < 3""", ("v_files",))
def cache_staleness(a: Adapters) -> DataFrame:
    """Every seventh file added, another removed, another touched since the cache was written."""
    k = F.col("file_id") % 7
    cached = a.files.filter(k != 0).select("path", F.col("file_id").cast("double").alias("mtime"))
    current = a.files.filter(k != 1).select("path", (F.col("file_id") + F.when(k == 2, 1).otherwise(0)).cast("double").alias("mtime"))
    return project.stale(cached, current)


def _reports(a: Adapters) -> DataFrame:
    inputs = a.scope.join(a.messages, "change_set_id").select("change_set_id", F.lit(None).cast("string").alias("prompt"), F.col("text").alias("cli_scope"), F.lit(None).cast("string").alias("head_message"), F.col("message").alias("pending_message"))
    return analyze.analyze(_changes(a), inputs, _nodes(a), a.edges, scopes=_scopes(a).withColumn("source", F.lit("cli")))


_RM = ("v_files", "v_changes", "v_scope", "v_edges", "v_messages")
_PARTS = "+ " + report_sql.parts(RISK, DOWN, TESTS, QUALITY, REASON, f"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))")


@query(_SCORED + """, level AS (SELECT change_set_id, CASE level WHEN 'info' THEN 'note' WHEN 'critical' THEN 'error' ELSE 'warning' END AS level FROM phantoms)
SELECT level, count(*) AS n FROM level GROUP BY level""", _RV, _KEPT)
def sarif_levels(a: Adapters) -> DataFrame:
    return _phantoms(a).groupBy(report.phantom_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


@query(_PARTS + report_sql.JSON, _RM)
def report_json(a: Adapters) -> DataFrame:
    return report.json(_reports(a))


@query(_PARTS + report_sql.SARIF, _RM)
def report_sarif(a: Adapters) -> DataFrame:
    return report.sarif(_reports(a))


@query(_PARTS + report_sql.MARKDOWN, _RM)
def report_markdown(a: Adapters) -> DataFrame:
    return report.markdown(_reports(a))


@query(_PARTS + report_sql.TERMINAL, _RM)
def report_terminal(a: Adapters) -> DataFrame:
    return report.terminal(_reports(a))
