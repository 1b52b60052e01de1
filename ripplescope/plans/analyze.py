"""The whole analysis of many change sets at once."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplescope.functions import globs
from ripplescope.operators import commits, graph, relevance, risk, scope, test_mapping
from ripplescope.plans import report
from ripplescope.plans.storage import settled


@dataclass(frozen=True)
class Config:
    """Thresholds, ignored paths, tests and scope areas (name -> {files, related})."""

    phantom_relevance: float = 0.3
    risk_safe: float = 0.3
    risk_danger: float = 0.6
    ignore: tuple[str, ...] = ()
    test_directories: tuple[str, ...] = test_mapping.DIRECTORIES
    test_patterns: tuple[str, ...] = test_mapping.PATTERNS
    test_command: str = "pytest {files} -v"
    areas: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    fail_on: str | None = None
    prompt_files: tuple[str, ...] = (".ripplescope-prompt", ".claude-prompt", ".cursor-prompt")


def scopes_of(inputs: DataFrame, changes: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """One scope for each change set: from its text (change_set_id, prompt, cli_scope, head_message) or its changes."""
    parsed = scope.parse(scope.resolve(inputs), files)
    inferred = scope.infer(changes).join(parsed.select("change_set_id"), "change_set_id", "left_anti")
    columns = ["change_set_id", "description", "target_files", "target_functions", "target_concepts", "confidence", "source"]
    scopes = parsed.select(columns).unionByName(inferred.select(columns))
    void = inputs.select("change_set_id").join(scopes.select("change_set_id"), "change_set_id", "left_anti")
    rows = [(name, kind, path) for name, kinds in config.areas.items() for kind, paths in kinds.items() for path in paths]
    if rows:
        scopes = scope.enrich(scopes, changes.sparkSession.createDataFrame(rows, "area string, kind string, path string"))
    return scopes.unionByName(scope.nothing(void))


def analyze(changes: DataFrame, inputs: DataFrame, files: DataFrame, edges: DataFrame, config: Config = Config(), scopes: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """(change_set_id, report) of each change set.

    changes as sources.diffs.parse gives them; inputs: change_set_id, prompt, cli_scope, head_message,
    pending_message (which alone is judged, if there is one); files: path and, for function matches, source;
    edges: src, dst; scopes: if they are known already; listing: path of all files of the project, if keywords may
    stand for others than `files`. Ignored changes are left out of everything, and so are change sets left empty.
    """
    if config.ignore:
        changes = changes.filter(~globs.user_ignored(F.col("file_path"), list(config.ignore)))
    changes, files, edges = settled(changes, "change_set_id"), settled(files), settled(edges)  # each is read many times from here on
    nodes = files.select("path")
    scopes = settled(scopes_of(inputs, changes, nodes if listing is None else listing, config) if scopes is None else scopes, "change_set_id")
    judged = settled(relevance.scored(changes, scopes, nodes, edges, config.phantom_relevance).select(*relevance.JUDGED), "change_set_id", True)
    strays = relevance.phantoms(judged)
    impacts = graph.downstream(changes, nodes, edges, scopes=scopes)
    scored = settled(risk.risk(judged, scopes, strays, edges, config.fail_on, config.risk_safe, config.risk_danger), "change_set_id", True)
    tests = test_mapping.suggest(changes, files, edges, config.test_directories, config.test_patterns)
    messages = inputs.select("change_set_id", F.regexp_replace(F.coalesce("pending_message", F.lit("")), scope.STRIP, "").alias("message"))
    quality = settled(commits.quality(messages.filter("message <> ''"), changes), "change_set_id", True)
    alive = scopes.join(changes.select("change_set_id").distinct(), "change_set_id", "left_semi")
    return report.assemble(alive, changes, strays, impacts, tests, scored, quality)
