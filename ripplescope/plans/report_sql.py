"""The four reports in DuckDB SQL, over the views of the test tables."""
from __future__ import annotations

from ripplescope.plans.report import ADVICE, RULES, TOOL, VERSION


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _percent(x: str) -> str:
    return f"concat(round_even(({x}) * 100, 0)::INT, '%')"


def _plural(n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN 'file' ELSE 'files' END"


def _padded(x: str, width: int) -> str:
    return f"CASE WHEN length({x}) < {width} THEN rpad({x}, {width}, ' ') ELSE {x} END"


def parts(risk: str, down: str, tests: str, quality: str, reason: str, words: str) -> str:
    """CTEs up to rep: one row for each change set with its lists as the reports have them; from the SQL of other queries."""
    down = down.replace("cent AS", "degrees AS").replace("JOIN cent ON", "JOIN degrees ON").replace("cent.", "degrees.").replace("FROM cent)", "FROM degrees)").replace("  round((CASE", "  ((CASE").replace(", 6) AS risk", ") AS risk").replace("array_to_string(w.via, '>') AS via", "w.via")
    tests = tests.replace(" c AS", " d AS", 1).replace("FROM c ", "FROM d ").replace("JOIN c ON c.change_set_id = x.change_set_id AND c.ordinal", "JOIN d ON d.change_set_id = x.change_set_id AND d.ordinal").replace("= c.file_path", "= d.file_path").replace("NOT c.", "NOT d.").replace("SELECT change_set_id, test_file, changed_file, 0.8", "SELECT change_set_id, ordinal, test_file, changed_file, 0.8")
    quality = quality.replace("hit AS (", "spoken AS (").replace("hit.change_set_id", "spoken.change_set_id").replace("JOIN hit ", "JOIN spoken ").replace(", w AS (", ", mentions AS (").replace("+ w AS (", "+ mentions AS (").replace("JOIN w USING", "JOIN mentions USING").replace("scored AS (", "messages AS (")
    return f"""{risk.lstrip("+ ")}, {down.lstrip("+ ")}, {tests.lstrip("+ ")}, {quality.lstrip("+ ")},
grouped AS (SELECT change_set_id, count(*) AS n, list_distinct(list(change_type)) AS kinds, list(regexp_replace(string_split(file_path, '/')[-1], '^(.+)\\.[^.]+$', '\\1') ORDER BY ordinal) AS stems,
 min(string_split(file_path, '/')) AS lo, max(string_split(file_path, '/')) AS hi FROM v_changes GROUP BY 1),
advised AS (SELECT change_set_id, concat(CASE WHEN kinds = ['added'] THEN 'feat' WHEN kinds = ['deleted'] THEN 'refactor' ELSE 'fix' END, CASE WHEN area = '' THEN '' ELSE concat('(', area, ')') END, ': update ',
  CASE WHEN n <= 3 THEN array_to_string(stems, ', ') ELSE concat(n, ' files in ', CASE WHEN area = '' THEN 'project' ELSE area END) END) AS suggestion
 FROM (SELECT *, CASE WHEN n = 1 THEN stems[1] WHEN lo[1] <> hi[1] THEN '' WHEN lo[2] <> hi[2] OR length(lo) = 2 OR length(hi) = 2 THEN lo[1] ELSE lo[2] END AS area FROM grouped)),
said AS (SELECT m.change_set_id, {{'message': message, 'score': round(score, 2), 'issues': list_filter([CASE WHEN vague THEN concat('Vague commit message: ''', message, '''') END, CASE WHEN short THEN concat('Commit message too short (', length(message), ' chars, minimum 10)') END,
  CASE WHEN stray THEN 'Message does not reference changed files or modules' END, CASE WHEN NOT conventional THEN 'Does not follow conventional commit format (type(scope): description)' END], lambda x: x IS NOT NULL),
  'is_vague': vague, 'suggested_improvement': CASE WHEN score < 0.5 THEN suggestion END}} AS quality FROM messages m LEFT JOIN advised USING (change_set_id) WHERE message <> ''),
changed AS (SELECT change_set_id, list({{'file_path': file_path, 'change_type': change_type, 'hunks': []::VARCHAR[], 'added_lines': added_lines, 'removed_lines': removed_lines, 'functions_modified': []::VARCHAR[], 'imports_modified': []::VARCHAR[],
  'language': 'unknown', 'is_new_file': is_new_file, 'is_deleted': is_deleted, 'old_path': NULL::VARCHAR}} ORDER BY ordinal) AS changed_files, sum(added_lines) AS added, sum(removed_lines) AS removed FROM v_changes GROUP BY 1),
strays AS (SELECT change_set_id, list({{'file_path': file_path, 'reason': {reason}, 'relevance_score': relevance,
  'change_summary': concat(CASE WHEN is_new_file THEN 'New file' WHEN is_deleted THEN 'Deleted file' ELSE 'Modified' END, ' ', file_path, ' [+', added_lines, '/-', removed_lines, ']'), 'severity': level, 'confidence': confidence,
  'added_lines': added_lines, 'removed_lines': removed_lines}} ORDER BY ordinal) AS phantom_changes FROM phantoms GROUP BY 1),
felt AS (SELECT change_set_id, list({{'file_path': file_path, 'distance': distance, 'via_files': via, 'risk_contribution': risk}} ORDER BY risk DESC, file_path) AS downstream_impacts FROM impacts i
 WHERE NOT EXISTS (SELECT 1 FROM v_scope s WHERE s.change_set_id = i.change_set_id AND s.target = i.file_path) GROUP BY 1),
run AS (SELECT change_set_id, list({{'test_file': test_file, 'changed_file': changed_file, 'match_reason': 'import chain match', 'confidence': confidence}} ORDER BY ordinal, test_file) AS suggested_tests FROM best GROUP BY 1),
rep AS (SELECT s.change_set_id, changed_files, added, removed, {{'description': text, 'target_files': [target], 'target_functions': []::VARCHAR[], 'target_concepts': list_distinct_ordered, 'confidence': s.confidence, 'source': 'cli'}} AS intended_scope,
  coalesce(phantom_changes, []) AS phantom_changes, coalesce(downstream_impacts, []) AS downstream_impacts, k.risk_score, k.risk_level, coalesce(suggested_tests, []) AS suggested_tests, quality
 FROM (SELECT *, list_filter({words}, lambda x, i: list_position({words}, x) = i) AS list_distinct_ordered FROM v_scope) s JOIN changed USING (change_set_id) LEFT JOIN classed k USING (change_set_id)
 LEFT JOIN strays USING (change_set_id) LEFT JOIN felt USING (change_set_id) LEFT JOIN run USING (change_set_id) LEFT JOIN said USING (change_set_id))"""


JSON = """ SELECT change_set_id, to_json({'changed_files': changed_files, 'intended_scope': intended_scope, 'phantom_changes': phantom_changes, 'downstream_impacts': downstream_impacts, 'risk_score': risk_score, 'risk_level': risk_level,
 'suggested_tests': suggested_tests, 'commit_message_quality': quality})::VARCHAR AS json FROM rep"""

_RULES = ", ".join(f"{{'id': '{i}', 'name': '{n}', 'shortDescription': {{'text': {_text(t)}}}, 'defaultConfiguration': {{'level': '{v}'}}}}" for i, n, t, v in RULES)
_AT = "[{'physicalLocation': {'artifactLocation': {'uri': x.file_path}}}]"
SARIF = f""" SELECT change_set_id, to_json({{'$schema': 'https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json', 'version': '2.1.0', 'runs': [{{'tool': {{'driver': {{'name': '{TOOL}', 'version': '{VERSION}', 'rules': [{_RULES}]}}}}, 'results':
 list_concat(list_transform(phantom_changes, lambda x: to_json({{'ruleId': 'DG001', 'level': CASE x.severity WHEN 'info' THEN 'note' WHEN 'critical' THEN 'error' ELSE 'warning' END, 'message': {{'text': concat(x.reason, ' (relevance: ', format('{{:.2f}}', x.relevance_score), ')')}},
   'locations': {_AT}, 'properties': {{'addedLines': x.added_lines, 'removedLines': x.removed_lines, 'confidence': x.confidence}}}})),
  list_transform(downstream_impacts, lambda x: to_json({{'ruleId': 'DG002', 'level': CASE WHEN x.distance = 1 THEN 'warning' ELSE 'note' END, 'message': {{'text': concat('Downstream impact: ', x.distance, '-hop away, risk contribution: ', format('{{:.2f}}', x.risk_contribution))}}, 'locations': {_AT}}})),
  CASE WHEN risk_level IN ('review', 'danger') THEN [to_json({{'ruleId': 'DG003', 'level': CASE WHEN risk_level = 'danger' THEN 'error' ELSE 'warning' END, 'message': {{'text': concat('Overall regression risk: ', risk_level, ' (score: ', format('{{:.2f}}', risk_score), ')')}}}})] ELSE [] END,
  CASE WHEN quality.score < 0.5 THEN [CASE WHEN quality.suggested_improvement IS NULL THEN to_json({{'ruleId': 'DG004', 'level': 'warning', 'message': {{'text': concat('Commit message quality: ', {_percent("quality.score")}, '. ', array_to_string(quality.issues, '; '))}}, 'properties': {{'isVague': quality.is_vague}}}})
   ELSE to_json({{'ruleId': 'DG004', 'level': 'warning', 'message': {{'text': concat('Commit message quality: ', {_percent("quality.score")}, '. ', array_to_string(quality.issues, '; '))}}, 'properties': {{'isVague': quality.is_vague, 'suggestedImprovement': quality.suggested_improvement}}}}) END] ELSE [] END)}}]}})::VARCHAR AS sarif FROM rep"""


def _listed(items: str, each: str, otherwise: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN '{otherwise}' ELSE array_to_string(list_transform({items}, lambda x: {each}), chr(10)) END"


_N = "chr(10)"
MARKDOWN = f""" SELECT change_set_id, replace(concat('## :shield: Blast Radius Report~~**Scope**: ', intended_scope.description, ' _(confidence: ', format('{{:.2f}}', intended_scope.confidence), ')_~**Risk Level**: ', risk_level, ' (score: ', format('{{:.2f}}', risk_score), ')~~',
 CASE WHEN quality IS NULL THEN '' ELSE concat('### :memo: Commit Message Quality (', {_percent("quality.score")}, ')~~> `', quality.message, '`~~', array_to_string(list_transform(quality.issues, lambda x: concat('- ', x, '~')), ''),
  CASE WHEN quality.suggested_improvement IS NULL THEN '' ELSE concat('- **Suggestion**: `', quality.suggested_improvement, '`~') END, '~') END,
 '### :white_check_mark: In Scope (', len(intended_scope.target_files), ' files)~~', {_listed("intended_scope.target_files", "concat('- `', x, '`')", "_No files in scope._")}, '~~',
 '### :page_facing_up: Changed Files (', len(changed_files), ')~~', {_listed("changed_files", "concat('- `', x.file_path, '` (', x.change_type, ', +', x.added_lines, '/-', x.removed_lines, ')')", "_No changes._")}, '~~',
 '### :ghost: Phantom Changes (', len(phantom_changes), ' files)~~', {_listed("phantom_changes", "concat('- `', x.file_path, '` [', x.severity, '] ', x.reason, ' (+', x.added_lines, '/-', x.removed_lines, ')')", "_No phantom changes detected._")}, '~~',
 '### :link: Downstream Impact (', len(downstream_impacts), ' files)~~', {_listed("downstream_impacts", "concat('- `', x.file_path, '` (distance: ', x.distance, ', risk: ', format('{:.2f}', x.risk_contribution), ', via: ', array_to_string(x.via_files, ' -> '), ')')", "_No downstream impact detected._")}, '~~',
 '### :test_tube: Suggested Tests (', len(suggested_tests), ')~~', {_listed("suggested_tests", "concat('- `', x.test_file, '` for `', x.changed_file, '` (', x.match_reason, ', confidence: ', format('{:.1f}', x.confidence), ')')", "_No test suggestions._")}, '~~',
 '### :bulb: Recommendation~~', CASE risk_level WHEN 'safe' THEN {_text(ADVICE["safe"])} WHEN 'review' THEN {_text(ADVICE["review"])} ELSE {_text(ADVICE["danger"])} END, '~'), '~', {_N}) AS markdown FROM rep"""


def _centred(x: str) -> str:
    cut = f"substr({x}, 1, 58)"
    return f"concat('│', repeat(' ', ((58 - length({cut})) // 2)::INT), {cut}, repeat(' ', (58 - length({cut}) - (58 - length({cut})) // 2)::INT), '│')"


_BAR = "─" * 58
_SAID = "CASE WHEN length(intended_scope.description) + 9 > 58 THEN concat(substr(concat('Scope: \"', intended_scope.description, '\"'), 1, 55), '...') ELSE concat('Scope: \"', intended_scope.description, '\"') END"
_MEANT = "CASE WHEN list_contains(list_transform(changed_files, lambda x: x.file_path), intended_scope.target_files[1]) THEN list_filter(changed_files, lambda x: x.file_path = intended_scope.target_files[1]) ELSE changed_files END"
_NEAR = "list_concat(list_filter(downstream_impacts, lambda x: x.distance = 1), list_filter(downstream_impacts, lambda x: x.distance = 2), list_filter(downstream_impacts, lambda x: x.distance = 3))"
TERMINAL = f""", shown AS (SELECT *, {_MEANT} AS meant, {_NEAR} AS near, greatest(0, least(20, round_even(risk_score * 20, 0)::INT)) AS filled FROM rep),
advice AS (SELECT *, concat(CASE WHEN risk_level = 'danger' THEN '❗' ELSE '\U0001f4a1' END, ' Recommendation: ', CASE risk_level WHEN 'safe' THEN 'Changes look safe and within scope.' WHEN 'danger' THEN 'High risk! Consider splitting changes into smaller commits.'
  ELSE CASE WHEN len(phantom_changes) > 0 THEN concat('Review changes to ', array_to_string(list_transform(phantom_changes, lambda x: x.file_path)[1:3], ' and '), ' manually.') ELSE 'Review changes before committing.' END END) AS words FROM shown)
SELECT change_set_id, concat(concat_ws(repeat(chr(10), 2),
 concat_ws(chr(10), '╭{_BAR}╮', {_centred(_text(TOOL + " blast radius"))}, '├{_BAR}┤', {_centred("''")}, {_centred(_SAID)}, {_centred("concat('Files changed: ', len(changed_files), '  |  Lines: +', added, ' / -', removed)")}, '╰{_BAR}╯'),
 concat('Risk level: ', CASE risk_level WHEN 'safe' THEN '✅' WHEN 'danger' THEN '\U0001f4a5' ELSE '⚠️' END, '  ', upper(risk_level), ' (score: ', format('{{:.2f}}', risk_score), ')', chr(10), '  [', repeat('█', filled), repeat('░', 20 - filled), '] ', {_percent("risk_score")}),
 CASE WHEN quality IS NOT NULL THEN concat(CASE WHEN quality.score >= 0.7 THEN '✅' WHEN quality.score >= 0.4 THEN '⚠️' ELSE '❌' END, ' Commit message quality: ', {_percent("quality.score")}, chr(10), '   "', quality.message, '"',
  array_to_string(list_transform(quality.issues, lambda x: concat(chr(10), '   - ', x)), ''), CASE WHEN quality.suggested_improvement IS NULL THEN '' ELSE concat(chr(10), '   Suggestion: ', quality.suggested_improvement) END) END,
 concat('✅ In scope (', len(meant), ' ', {_plural("len(meant)")}, '):', chr(10), array_to_string(list_transform(meant, lambda x: concat('   ', {_padded("x.file_path", 28)}, ' +', x.added_lines, ' / -', x.removed_lines)), chr(10))),
 CASE WHEN len(phantom_changes) > 0 THEN concat('⚠️  Phantom changes (', len(phantom_changes), ' ', {_plural("len(phantom_changes)")}, '):', chr(10),
  array_to_string(list_transform(phantom_changes, lambda x: concat('   ', {_padded("x.file_path", 28)}, '+', x.added_lines, ' / -', x.removed_lines, '    [confidence: ', {_percent("x.confidence")}, ']', chr(10), '   │  → ', x.reason)), chr(10))) END,
 CASE WHEN len(near) > 0 THEN concat('\U0001f4a5 Downstream blast radius:', chr(10), array_to_string(list_transform(near, lambda x, i: concat('   ', CASE WHEN i = len(near) THEN '└── ' ELSE '├── ' END, {_padded("x.file_path", 28)}, ' ',
  CASE WHEN x.distance > 1 THEN concat(x.distance, '-hop') ELSE 'direct' END, '  via ', array_to_string(x.via_files, ' -> '))), chr(10))) END,
 concat('\U0001f9ea Suggested tests to run:', chr(10), '   ', CASE WHEN len(suggested_tests) = 0 THEN 'No test files found.' ELSE concat('pytest ', array_to_string(list_sort(list_distinct(list_transform(suggested_tests, lambda x: x.test_file))), ' '), ' -v', repeat(chr(10), 2),
  array_to_string(list_transform(suggested_tests, lambda x: concat('   ', {_padded("x.test_file", 32)}, ' <- ', x.changed_file, '  (', x.match_reason, ')')), chr(10))) END),
 CASE WHEN length(words) > 90 THEN concat(substr(words, 1, 87), '...') ELSE words END), chr(10)) AS terminal FROM advice"""
