"""Configuration of a project: a small subset of YAML, ignore files and prompt files. Read on the driver."""
from __future__ import annotations

import re
from pathlib import Path

from ripplescope.plans.analyze import Config

# Names of the files that are looked for, and how far up.
CONFIG_NAMES, IGNORE_NAME, PARENTS = (".ripplescope.yml", ".ripplescope.yaml"), ".ripplescopeignore", 20
_WORDS = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "~": None, "": None}


def scalar(text: str) -> object:
    """A value as written after a key or a dash."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",")] if text[1:-1].strip() else []
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return text


def _uncommented(line: str) -> str:
    """The line up to a '#' that begins it or follows white space outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def parse(text: str) -> dict[str, object]:
    """Nested keys, lists and scalars; lines of any other form are left out."""
    rows = [(len(s) - len(s.lstrip()), s.strip()) for s in map(_uncommented, text.splitlines()) if s.strip()]

    def block(at: int, indent: int) -> tuple[object, int]:
        if at < len(rows) and rows[at][1].startswith("-"):
            items: list[object] = []
            while at < len(rows) and rows[at][0] == indent and rows[at][1].startswith("-"):
                items.append(scalar(rows[at][1][1:]))
                at += 1
            return items, at
        found: dict[str, object] = {}
        while at < len(rows) and rows[at][0] >= indent:
            key, colon, value = rows[at][1].partition(":")
            deeper = at + 1 < len(rows) and (rows[at + 1][0] > rows[at][0] or rows[at + 1][0] == rows[at][0] and rows[at + 1][1].startswith("- "))
            if colon and not value.strip() and deeper:
                found[scalar(key) if key[:1] in "'\"" else key.strip()], at = block(at + 1, rows[at + 1][0])
            else:
                if colon:
                    found[key.strip().strip("'\"")] = scalar(value)
                at += 1
        return found, at

    out = block(0, rows[0][0])[0] if rows else {}
    return out if isinstance(out, dict) else {}


def ignored(folder: str | Path) -> list[str]:
    """Patterns of the ignore file: lines without blanks and comments; '!' is kept as it is."""
    path = Path(folder, IGNORE_NAME)
    lines = path.read_text(errors="replace").splitlines() if path.is_file() else []
    return [s for s in map(str.strip, lines) if s and not s.startswith("#")]


def prompt(folder: str | Path, names: tuple[str, ...] = Config.prompt_files) -> str:
    """The text of the first prompt file there is, or nothing."""
    return next((p.read_text(errors="replace") for p in (Path(folder, n) for n in names) if p.is_file()), "")


def of(data: dict[str, object]) -> Config:
    """A Config; values of a wrong type give way to defaults."""
    base = Config()
    part = lambda name: v if isinstance(v := data.get(name), dict) else {}
    number = lambda d, k, other: float(v) if isinstance(v := d.get(k), int | float) and not isinstance(v, bool) else other
    texts = lambda v, other: tuple(map(str, v)) if isinstance(v, list) else other
    limits, tests, hook, areas = part("thresholds"), part("tests"), part("hook"), part("scope").get("areas")
    known = {}
    for name, kinds in (areas if isinstance(areas, dict) else {}).items():
        if isinstance(kinds, dict):
            known[str(name)] = {k: [str(x) for x in v] for k, v in kinds.items() if k in ("files", "related") and isinstance(v, list)}
    return Config(
        number(limits, "phantom_relevance", base.phantom_relevance), number(limits, "risk_safe", base.risk_safe), number(limits, "risk_danger", base.risk_danger),
        texts(data.get("ignore"), base.ignore), tuple(d.rstrip("/") for d in texts(tests.get("directories"), base.test_directories)), texts(tests.get("patterns"), base.test_patterns),
        c if isinstance(c := tests.get("command"), str) else base.test_command, known, f if isinstance(f := hook.get("fail_on"), str) else base.fail_on,
        texts(part("scope").get("prompt_files"), base.prompt_files),
    )


def default_text() -> str:
    """A configuration file that says what holds without one."""
    base = Config()
    listed = lambda items, depth: "".join(f"{' ' * depth}- \"{x}\"\n" for x in items)
    ignored = ("*.lock", "*.min.js", "*.min.css", "node_modules/", "vendor/", "__pycache__/", ".git/", "migrations/")
    return (
        "version: 1\n\n# Shares from 0 to 1\nthresholds:\n"
        f"  phantom_relevance: {base.phantom_relevance}  # changes of lower relevance are reported\n  risk_safe: {base.risk_safe}\n  risk_danger: {base.risk_danger}\n\n"
        f"# Changed files to leave out\nignore:\n{listed(ignored, 2)}\n"
        f"tests:\n  directories:\n{listed([f'{d}/' for d in base.test_directories], 4)}  patterns:\n{listed(base.test_patterns, 4)}  command: \"{base.test_command}\"\n\n"
        f"scope:\n  prompt_files:\n{listed(base.prompt_files, 4)}  # areas:\n  #   name:\n  #     files:\n  #       - \"src/name/\"\n  #     related:\n  #       - \"src/other.py\"\n\n"
        "hook:\n  fail_on: \"danger\"  # safe, review, danger or never\n"
    )


def init(folder: str | Path) -> Path:
    """Writes default_text() where there is no configuration yet."""
    path = Path(folder, CONFIG_NAMES[0])
    if path.exists():
        raise FileExistsError(f"{path} is there already")
    path.write_text(default_text())
    return path


def find(folder: str | Path) -> Config:
    """The nearest configuration at or above a folder, with its ignore file's patterns after its own."""
    at = Path(folder).resolve()
    for place in (at, *list(at.parents)[:PARENTS]):
        for name in CONFIG_NAMES:
            if (file := place / name).is_file():
                data = parse(file.read_text(errors="replace"))
                own = data.get("ignore")
                return of(data | {"ignore": [*(own if isinstance(own, list) else []), *ignored(place)]})
    return of({"ignore": ignored(folder)})
