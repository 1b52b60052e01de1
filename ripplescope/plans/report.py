"""One nested report row for each change set, and its JSON, SARIF and Markdown forms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplescope.functions import numbers, paths
from ripplescope.operators import test_mapping

TOOL, VERSION = "ripplescope", "0.1.0"
#: Fields of a changed file, and what stands for those that the changes don't have.
CHANGE = {
    "file_path": None, "change_type": None,
    "hunks": "array<struct<old_start:int,old_count:int,new_start:int,new_count:int,content:string,function_header:string>>",
    "added_lines": None, "removed_lines": None, "functions_modified": "array<string>", "imports_modified": "array<string>",
    "language": "string", "is_new_file": None, "is_deleted": None, "old_path": "string",
}
# Rules of the SARIF log.
RULES = (
    ("DG001", "PhantomChange", "Change detected outside the intended scope", "warning"),
    ("DG002", "HighBlastRadius", "Significant downstream impact detected", "note"),
    ("DG003", "RegressionRisk", "High regression risk score", "warning"),
    ("DG004", "CommitMessageQuality", "Low quality or vague commit message", "note"),
)
# Headings and closing words of the Markdown and terminal reports, by risk level where they differ.
ADVICE = {
    "safe": "Changes appear safe and within scope. Proceed with confidence.",
    "review": "Some concerns detected. Consider reviewing phantom changes and downstream impacts before proceeding.",
    "danger": "**High risk detected.** Significant blast radius or phantom changes. Strongly recommend thorough review and testing before committing.",
}


def _listed(rows: DataFrame, name: str, order: list[Column], *columns: str) -> DataFrame:
    """(change_set_id, name): the rows' columns as an array of structs in the given order."""
    packed = F.array_sort(F.collect_list(F.struct(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("o"), F.struct(*columns).alias("v"))))
    return rows.groupBy("change_set_id").agg(F.transform(packed, lambda x: x["v"]).alias(name))


def assemble(scopes: DataFrame, changes: DataFrame, phantoms: DataFrame, impacts: DataFrame, tests: DataFrame, risk: DataFrame, quality: DataFrame) -> DataFrame:
    """(change_set_id, report)."""
    c = F.col
    for name, kind in CHANGE.items():
        if name not in changes.columns:
            other = F.array().cast(kind) if kind.startswith("array") else F.lit("unknown" if name == "language" else None).cast(kind)
            changes = changes.withColumn(name, other)
    parts = (
        ("changed_files", _listed(changes, "changed_files", [c("ordinal")], *CHANGE)),
        ("phantom_changes", _listed(phantoms, "phantom_changes", [c("ordinal")], "file_path", "reason", "relevance_score", "change_summary", "severity", "confidence", "added_lines", "removed_lines")),
        ("downstream_impacts", _listed(impacts, "downstream_impacts", [-c("risk_contribution"), c("file_path")], "file_path", "distance", "via_files", "risk_contribution")),
        ("suggested_tests", _listed(tests, "suggested_tests", [c("place")], "test_file", "changed_file", "match_reason", "confidence")),
    )
    intended = F.struct("description", "target_files", "target_functions", "target_concepts", c("confidence"), "source").alias("intended_scope")
    rows = scopes.select("change_set_id", intended)
    for name, part in parts:
        kind = part.schema[name].dataType
        rows = rows.join(part, "change_set_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    rows = rows.join(risk.select("change_set_id", "risk_score", "risk_level", "exit_code"), "change_set_id", "left")
    message = F.when(c("score").isNotNull(), F.struct("message", "score", "issues", "is_vague", "suggested_improvement")).alias("commit_message_quality")
    rows = rows.join(quality.select("change_set_id", message), "change_set_id", "left")
    fields = ("changed_files", "intended_scope", "phantom_changes", "downstream_impacts", "risk_score", "risk_level", "suggested_tests", "commit_message_quality", "exit_code")
    return rows.select("change_set_id", F.struct(*fields).alias("report"))


# A number that to_json was given as text with @ before it; within a text the quotes would be escaped.
_NUMBER = r'(?<!\\)("(?:risk_score|relevance_score|risk_contribution|confidence|score)":)"@([0-9.]+)"'


def json(reports: DataFrame) -> DataFrame:
    """(change_set_id, json); numbers as the shortest text that reads back the same."""
    r = F.col("report")
    number = lambda x: F.concat(F.lit("@"), numbers.shortest(x))
    each = lambda name, *fields: F.transform(r[name], lambda x: _with(x, {f: number(x[f]) for f in fields}))
    quality, scope = r["commit_message_quality"], r["intended_scope"]
    told = _with(r.dropFields("exit_code"), {
        "phantom_changes": each("phantom_changes", "relevance_score", "confidence"), "downstream_impacts": each("downstream_impacts", "risk_contribution"),
        "suggested_tests": each("suggested_tests", "confidence"), "intended_scope": _with(scope, {"confidence": number(scope["confidence"])}),
        "commit_message_quality": F.when(quality.isNotNull(), _with(quality, {"score": number(quality["score"])})), "risk_score": number(r["risk_score"]),
    })
    return reports.select("change_set_id", F.regexp_replace(F.to_json(told, {"ignoreNullFields": "false"}), _NUMBER, "$1$2").alias("json"))


def _with(x: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        x = x.withField(name, value)
    return x


def phantom_level(severity: Column) -> Column:
    return F.when(severity == "info", "note").when(severity == "critical", "error").otherwise("warning")


def impact_level(distance: Column) -> Column:
    return F.when(distance == 1, "warning").otherwise("note")


def sarif(reports: DataFrame) -> DataFrame:
    """(change_set_id, sarif): a SARIF 2.1.0 log of each report."""
    r = lambda name: F.col(f"report.{name}")
    locations = lambda uri: F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    none = F.lit(None)
    shape = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>, properties struct<addedLines:bigint,removedLines:bigint,confidence:double,isVague:boolean,suggestedImprovement:string>"
    kind = f"struct<{', '.join(f.replace(' ', ':', 1) for f in shape.split(', '))}>"

    def result(rule: str, level: Column, text: Column, where: Column, *properties: Column) -> Column:
        names = ("addedLines", "removedLines", "confidence", "isVague", "suggestedImprovement")
        own = F.struct(*[p.alias(n) for n, p in zip(names, properties)]) if properties else none
        return F.struct(F.lit(rule).alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), where.alias("locations"), own.alias("properties")).cast(kind)

    found = F.transform(r("phantom_changes"), lambda p: result("DG001", phantom_level(p["severity"]), F.format_string("%s (relevance: %s)", p["reason"], numbers.fixed(p["relevance_score"])), locations(p["file_path"]), p["added_lines"], p["removed_lines"], p["confidence"], none, none))
    felt = F.transform(r("downstream_impacts"), lambda d: result("DG002", impact_level(d["distance"]), F.format_string("Downstream impact: %d-hop away, risk contribution: %s", d["distance"], numbers.fixed(d["risk_contribution"])), locations(d["file_path"])))
    level, quality = r("risk_level"), r("commit_message_quality")
    risky = result("DG003", F.when(level == "danger", "error").otherwise("warning"), F.format_string("Overall regression risk: %s (score: %s)", level, numbers.fixed(r("risk_score"))), none)
    poor = result("DG004", F.lit("warning"), F.concat(F.format_string("Commit message quality: %s. ", numbers.percent(quality["score"])), F.array_join(quality["issues"], "; ")), none, none, none, none, quality["is_vague"], quality["suggested_improvement"])
    empty = F.array().cast(f"array<{kind}>")
    results = F.concat(found, felt, F.when(level.isin("review", "danger"), F.array(risky)).otherwise(empty), F.when(F.coalesce(quality["score"] < 0.5, F.lit(False)), F.array(poor)).otherwise(empty))
    rules = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.struct(F.lit(t).alias("text")).alias("shortDescription"), F.struct(F.lit(v).alias("level")).alias("defaultConfiguration")) for i, n, t, v in RULES])
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(VERSION).alias("version"), rules.alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), results.alias("results"))
    schema = F.lit("https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json")
    return reports.select("change_set_id", F.to_json(F.struct(schema.alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def markdown(reports: DataFrame) -> DataFrame:
    """(change_set_id, markdown)."""
    r = lambda name: F.col(f"report.{name}")
    lines = lambda items, each, otherwise: F.when(F.size(items) == 0, otherwise).otherwise(F.array_join(F.transform(items, each), "\n"))
    fmt = F.format_string
    scope, quality = r("intended_scope"), r("commit_message_quality")
    said = F.when(scope["description"] == "", "N/A").otherwise(scope["description"])
    first = F.split(F.regexp_replace(quality["message"], r"(?U)^\s+|\s+$", ""), "\n")[0]
    message = F.concat(
        fmt("### :memo: Commit Message Quality (%s)\n\n> `%s`\n\n", numbers.percent(quality["score"]), first),
        F.array_join(F.concat(F.transform(quality["issues"], lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), F.array_compact(F.array(F.concat(F.lit("- **Suggestion**: `"), quality["suggested_improvement"], F.lit("`\n"))))), ""),
        F.lit("\n"),
    )
    advice = F.when(r("risk_level") == "safe", ADVICE["safe"]).when(r("risk_level") == "review", ADVICE["review"]).otherwise(ADVICE["danger"])
    blocks = (
        fmt("## :shield: Blast Radius Report\n\n**Scope**: %s _(confidence: %s)_\n**Risk Level**: %s (score: %s)\n\n", said, numbers.fixed(scope["confidence"]), r("risk_level"), numbers.fixed(r("risk_score"))),
        F.coalesce(message, F.lit("")),
        fmt("### :white_check_mark: In Scope (%d files)\n\n%s\n\n", F.size(scope["target_files"]), lines(F.array_sort(scope["target_files"]), lambda f: fmt("- `%s`", f), "_No files in scope._")),
        fmt("### :page_facing_up: Changed Files (%d)\n\n%s\n\n", F.size(r("changed_files")), lines(r("changed_files"), lambda c: fmt("- `%s` (%s, +%d/-%d)", c["file_path"], c["change_type"], c["added_lines"], c["removed_lines"]), "_No changes._")),
        fmt("### :ghost: Phantom Changes (%d files)\n\n%s\n\n", F.size(r("phantom_changes")), lines(r("phantom_changes"), lambda p: fmt("- `%s` [%s] %s (+%d/-%d)", p["file_path"], p["severity"], p["reason"], p["added_lines"], p["removed_lines"]), "_No phantom changes detected._")),
        fmt("### :link: Downstream Impact (%d files)\n\n%s\n\n", F.size(r("downstream_impacts")), lines(r("downstream_impacts"), lambda d: fmt("- `%s` (distance: %d, risk: %s, via: %s)", d["file_path"], d["distance"], numbers.fixed(d["risk_contribution"]), F.array_join(d["via_files"], " -> ")), "_No downstream impact detected._")),
        fmt("### :test_tube: Suggested Tests (%d)\n\n%s\n\n", F.size(r("suggested_tests")), lines(r("suggested_tests"), lambda t: fmt("- `%s` for `%s` (%s, confidence: %.1f)", t["test_file"], t["changed_file"], t["match_reason"], t["confidence"]), "_No test suggestions._")),
        F.concat(F.lit("### :bulb: Recommendation\n\n"), advice, F.lit("\n")),
    )
    return reports.select("change_set_id", F.concat(*blocks).alias("markdown"))


_GREEN, _YELLOW, _RED, _PLAIN = "\033[32m", "\033[33m", "\033[31m", "\033[0m"
_WIDE = 58  # characters between the sides of the box


def _centred(text: Column) -> Column:
    cut = F.substring(text, 1, _WIDE)
    left = F.floor((_WIDE - F.length(cut)) / 2).cast("int")
    return F.concat(F.lit("\u2502"), F.repeat(F.lit(" "), left), cut, F.repeat(F.lit(" "), F.lit(_WIDE) - F.length(cut) - left), F.lit("\u2502"))


def _padded(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def _box(description: Column, files: Column, added: Column, removed: Column) -> Column:
    said = F.concat(F.lit('Scope: "'), description, F.lit('"'))
    said = F.when(F.length(said) > _WIDE, F.concat(F.substring(said, 1, _WIDE - 3), F.lit("..."))).otherwise(said)
    counts = F.format_string("Files changed: %d  |  Lines: +%d / -%d", files, added, removed)
    bar = "\u2500" * _WIDE
    rows = (F.lit(f"\u256d{bar}\u256e"), _centred(F.lit(f"{TOOL} blast radius")), F.lit(f"\u251c{bar}\u2524"), _centred(F.lit("")), _centred(said), _centred(counts), F.lit(f"\u2570{bar}\u256f"))
    return F.concat_ws("\n", *rows)


def terminal(reports: DataFrame, color: bool = False) -> DataFrame:
    """(change_set_id, terminal): the report for people, with ANSI colours if wanted."""
    r = lambda name: F.col(f"report.{name}")
    fmt, lines = F.format_string, lambda items, each: F.array_join(F.transform(items, each), "\n")
    paint = lambda text, code: F.concat(code, text, F.lit(_PLAIN)) if color else text
    by_level = lambda safe, review, danger: F.when(level == "safe", safe).when(level == "danger", danger).otherwise(review)
    level, score, quality, scope = r("risk_level"), r("risk_score"), r("commit_message_quality"), r("intended_scope")
    changed, strays, felt, tests = r("changed_files"), r("phantom_changes"), r("downstream_impacts"), r("suggested_tests")
    total = lambda name: F.aggregate(changed, F.lit(0).cast("long"), lambda a, x: a + x[name])
    shade = by_level(_GREEN, _YELLOW, _RED)
    full = F.greatest(F.lit(0), F.least(F.lit(20), F.bround(score * 20).cast("int")))
    bar = F.concat(F.repeat(F.lit("\u2588"), full), F.repeat(F.lit("\u2591"), 20 - full))
    gauge = F.concat(F.lit("Risk level: "), by_level("\u2705", "\u26a0\ufe0f", "\U0001f4a5"), F.lit("  "), paint(F.upper(level), shade), fmt(" (score: %s)\n  [", numbers.fixed(score)), paint(bar, shade), F.lit("] "), numbers.percent(score))
    first = F.split(F.regexp_replace(quality["message"], r"(?U)^\s+|\s+$", ""), "\n")[0]
    good = lambda high, middle, low: F.when(quality["score"] >= 0.7, high).when(quality["score"] >= 0.4, middle).otherwise(low)
    message = F.concat(
        good("\u2705", "\u26a0\ufe0f", "\u274c"), F.lit(" Commit message quality: "), paint(numbers.percent(quality["score"]), good(_GREEN, _YELLOW, _RED)), F.lit('\n   "'), first, F.lit('"'),
        F.array_join(F.concat(F.transform(quality["issues"], lambda i: F.concat(F.lit("\n   - "), i)), F.array_compact(F.array(F.concat(F.lit("\n   Suggestion: "), quality["suggested_improvement"])))), ""),
    )
    named = F.filter(changed, lambda c: F.array_contains(scope["target_files"], c["file_path"]))
    meant = F.when(F.size(named) > 0, named).otherwise(changed)
    heading = F.concat(F.lit("\u2705 In scope ("), F.size(meant).cast("string"), F.lit(" "), paths.plural(F.size(meant), "file"), F.lit("):"))
    functions = lambda c: F.when(F.size(c["functions_modified"]) > 0, F.concat(F.lit("   "), F.array_join(c["functions_modified"], ", "))).otherwise("")
    inside = F.concat(paint(heading, F.lit(_GREEN)), F.lit("\n"), lines(meant, lambda c: F.concat(F.lit("   "), _padded(c["file_path"], 28), fmt(" +%d / -%d", c["added_lines"], c["removed_lines"]), functions(c))))
    stray = lambda p: F.concat(F.lit("   "), _padded(p["file_path"], 28), fmt("+%d / -%d    [confidence: ", p["added_lines"], p["removed_lines"]), numbers.percent(p["confidence"]), F.lit("]"))
    outside = F.concat(
        paint(F.concat(F.lit("\u26a0\ufe0f  Phantom changes ("), F.size(strays).cast("string"), F.lit(" "), paths.plural(F.size(strays), "file"), F.lit("):")), F.lit(_YELLOW)), F.lit("\n"),
        lines(strays, lambda p: F.concat(paint(stray(p), F.when(p["severity"].isin("info", "warning"), _YELLOW).otherwise(_RED)), F.lit("\n   \u2502  \u2192 "), p["reason"])),
    )
    near = F.transform(F.array_sort(F.transform(felt, lambda d, i: F.struct(d["distance"].alias("d"), i.alias("i"), d.alias("v")))), lambda x: x["v"])
    hops = lambda d: F.when(d["distance"] > 1, fmt("%d-hop", d["distance"])).otherwise("direct")
    via = lambda d: F.when(F.size(d["via_files"]) > 0, F.concat(F.lit("  via "), F.array_join(d["via_files"], " -> "))).otherwise("")
    branch = lambda i: F.when(i == F.size(near) - 1, "\u2514\u2500\u2500 ").otherwise("\u251c\u2500\u2500 ")
    tree = F.concat(paint(F.lit("\U0001f4a5 Downstream blast radius:"), F.lit(_RED)), F.lit("\n"), F.array_join(F.transform(near, lambda d, i: F.concat(F.lit("   "), branch(i), _padded(d["file_path"], 28), F.lit(" "), hops(d), via(d))), "\n"))
    run = F.concat(F.lit("pytest "), F.array_join(F.array_sort(F.array_distinct(F.transform(tests, lambda t: t["test_file"]))), " "), F.lit(" -v"))
    listed = F.concat(run, F.lit("\n\n"), lines(tests, lambda t: F.concat(F.lit("   "), _padded(t["test_file"], 32), F.lit(" <- "), t["changed_file"], F.lit("  ("), t["match_reason"], F.lit(")"))))
    suggested = F.concat(F.lit("\U0001f9ea Suggested tests to run:\n   "), F.when(F.size(tests) > 0, listed).otherwise("No test files found."))
    look = F.concat(F.lit("Review changes to "), F.array_join(F.slice(F.transform(strays, lambda p: p["file_path"]), 1, 3), " and "), F.lit(" manually."))
    words = by_level(F.lit("Changes look safe and within scope."), F.when(F.size(strays) > 0, look).otherwise("Review changes before committing."), F.lit("High risk! Consider splitting changes into smaller commits."))
    last = F.concat(by_level("\U0001f4a1", "\U0001f4a1", "\u2757"), F.lit(" Recommendation: "), words)
    last = F.when(F.length(last) > 90, F.concat(F.substring(last, 1, 87), F.lit("..."))).otherwise(last)
    sections = (_box(scope["description"], F.size(changed), total("added_lines"), total("removed_lines")), gauge, message, inside, F.when(F.size(strays) > 0, outside), F.when(F.size(felt) > 0, tree), suggested, last)
    return reports.select("change_set_id", F.concat(F.concat_ws("\n\n", *sections), F.lit("\n")).alias("terminal"))


def _tested(changes: DataFrame, suggested: DataFrame, template: str) -> DataFrame:
    """(change_set_id, changes, tests, command); command is empty without tests."""
    c = F.col
    files = _listed(changes, "changes", [c("ordinal")], "file_path", "change_type", "added_lines", "removed_lines")
    tests = _listed(suggested, "tests", [c("place")], "test_file", "changed_file", "match_reason", "confidence")
    rows = files.join(tests, "change_set_id", "left").join(test_mapping.command(suggested, template), "change_set_id", "left")
    return rows.withColumns({"tests": F.coalesce("tests", F.array().cast(tests.schema["tests"].dataType)), "command": F.coalesce("command", F.lit(""))})


def tests_json(changes: DataFrame, suggested: DataFrame, template: str = "pytest {files} -v") -> DataFrame:
    """(change_set_id, json) of the tests that test_mapping.suggest() gives for the changes."""
    file = lambda x: F.struct(x["file_path"].alias("path"), x["change_type"].alias("type"), x["added_lines"].alias("added_lines"), x["removed_lines"].alias("removed_lines"))
    rows = _tested(changes, suggested, template)
    return rows.select("change_set_id", F.to_json(F.struct(F.transform("changes", file).alias("changed_files"), F.col("tests").alias("test_suggestions"), F.col("command").alias("test_command"))).alias("json"))


def tests_text(changes: DataFrame, suggested: DataFrame, template: str = "pytest {files} -v") -> DataFrame:
    """(change_set_id, text): the same for people."""
    rows = _tested(changes, suggested, template)
    hit = lambda t: F.format_string("    -> %s (%s, confidence: %.1f)\n", t["test_file"], t["match_reason"], t["confidence"])

    def of(x: Column) -> Column:
        own = F.filter("tests", lambda t: t["changed_file"] == x["file_path"])
        found = F.when(F.size(own) > 0, F.array_join(F.transform(own, hit), "")).otherwise("    -> no test files found\n")
        return F.concat(F.format_string("  %s (%s)\n", x["file_path"], x["change_type"]), found, F.lit("\n"))

    end = F.when(F.col("command") != "", F.concat(F.lit("Suggested test command:\n  "), F.col("command"))).otherwise("No test files found for the changed files.")
    return rows.select("change_set_id", F.concat(F.lit("Changed files and suggested tests:\n\n"), F.array_join(F.transform("changes", of), ""), end).alias("text"))
