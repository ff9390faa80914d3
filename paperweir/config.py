"""Configuration: a closed JSON document checked against a table of rules, resolved with explicit > environment > file > default."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from paperweir.operators.vault import RESERVED, unknown_variables
from paperweir.schemas import FORMATS, MODES

Rule = Callable[[Any], str | None]


def text(v: Any) -> str | None:
    return None if isinstance(v, str) and v.strip() else "must be a non-empty string"


def boolean(v: Any) -> str | None:
    return None if isinstance(v, bool) else "must be a boolean"


def one_of(*values: str) -> Rule:
    return lambda v: None if v in values else f"must be one of {', '.join(values)}"


def matching(pattern: str, said: str) -> Rule:
    return lambda v: text(v) or (None if re.fullmatch(pattern, v) else said)


def port(v: Any) -> str | None:
    return None if isinstance(v, int) and not isinstance(v, bool) and 1 <= v <= 65535 else "must be an integer from 1 to 65535"


def strings(v: Any) -> str | None:
    if not isinstance(v, list) or any(text(x) for x in v):
        return "must contain non-empty strings"
    return None if len(set(v)) == len(v) else "must not contain duplicates"


def folder(v: Any) -> str | None:
    if bad := text(v):
        return bad
    v = v.rstrip("/")
    if v.startswith("/") or re.match("[A-Za-z]:", v) or "\\" in v:
        return "must be relative"
    return "contains an unsafe path segment" if any(p in ("", ".", "..") for p in v.split("/")) else None


def template(v: Any) -> str | None:
    if bad := text(v):
        return bad
    if names := unknown_variables(v):
        return f"contains unsupported variable {names[0]}"
    return "is malformed" if re.search(r"\{\{|\}\}", re.sub(r"\{\{\s*[^{}]+?\s*\}\}", "", v)) else None


def properties(v: Any) -> str | None:
    if not isinstance(v, dict):
        return "must be a JSON object"
    for k, x in v.items():
        if k in RESERVED:
            return f"cannot replace reserved property {k}"
        if not k.strip() or "\n" in k or "\r" in k:
            return "keys must be non-empty single-line strings"
        if not isinstance(x, (str, int, float, bool)) and (bad := strings(x)):
            return f"{k} {bad}"
    return None


_ENV = matching("[A-Z_][A-Z0-9_]*", "must be an uppercase environment variable name")
RULES: dict[str, Any] = {
    "schemaVersion": lambda v: None if v == 1 else "must be 1",
    "libraryDir": text,
    "defaults": {"mode": one_of(*MODES), "exportFormat": one_of(*FORMATS)},
    "obsidian": {"vaultPath": text, "vaultName": text, "inboxFolder": folder, "attachmentFolder": folder, "noteNameTemplate": template, "tags": strings, "frontmatter": properties, "openAfterExport": boolean},
    "kindle": {
        "deviceLabel": matching(r"[^\r\n]+", "must be a single-line string"), "defaultFormat": one_of("epub", "pdf"), "credentialStore": one_of("system", "environment"),
        "credentialProfile": matching("[a-z0-9][a-z0-9._-]{0,63}", "must use lowercase letters, digits, dots, underscores, or hyphens"), "recipientEnv": _ENV,
        "smtp": {"host": matching(r"[^@/\s:]+", "must be a hostname"), "port": port, "secure": boolean, "userEnv": _ENV, "passwordEnv": _ENV, "fromEnv": _ENV},
    },
}
REQUIRED = {"": ("schemaVersion",), "obsidian": ("vaultPath",)}


def problems(config: Any, rules: dict[str, Any] = RULES, at: str = "") -> list[str]:
    """Everything that is wrong with a configuration document, by dotted name."""
    if not isinstance(config, dict):
        return [f"{at or 'configuration'} must be a JSON object"]
    dot = f"{at}." if at else ""
    out = [f"{at or 'configuration'} contains unsupported property {k}" for k in config if k not in rules]
    out += [f"{dot}{k} is required" for k in REQUIRED.get(at, ()) if k not in config]
    for k, rule in rules.items():
        if k in config:
            if isinstance(rule, dict):
                out += problems(config[k], rule, dot + k)
            elif said := rule(config[k]):
                out.append(f"{dot}{k} {said}")
    return out


def check(config: Any) -> dict[str, Any]:
    if bad := problems(config):
        raise ValueError("; ".join(bad))
    return config


def expand(path: str, base: str | os.PathLike, home: str | os.PathLike) -> Path:
    """Absolute path; ~ and ~/x are of the home folder, other ~ forms refused."""
    if path == "~" or path.startswith(("~/", "~\\")):
        return Path(os.path.normpath(Path(home) / path[2:]))
    if path.startswith("~"):
        raise ValueError(f"Unsupported home-relative path: {path}")
    return Path(os.path.normpath(Path(base) / path))


@dataclass
class Resolved:
    """Where the configuration and the library lie, and the sections with their defaults."""

    config_path: Path
    library_dir: Path
    config: dict[str, Any] = field(default_factory=dict)


DEFAULTS = {
    "obsidian": {"inboxFolder": "Reading Inbox", "attachmentFolder": "Attachments/paperweir", "noteNameTemplate": "{{title}}", "tags": ["paperweir"], "frontmatter": {}, "openAfterExport": False},
    "kindle": {"defaultFormat": "epub", "credentialStore": "environment", "credentialProfile": "default", "smtp": {"port": 587, "secure": False}},
}


def read(path: str | os.PathLike) -> dict[str, Any]:
    """The document at path; a missing file is the empty configuration."""
    try:
        return check(json.loads(Path(path).read_text(encoding="utf-8")))
    except FileNotFoundError:
        return {"schemaVersion": 1}


def resolve(config_path: str | None = None, library_dir: str | None = None, env: Mapping[str, str] | None = None, home: str | None = None, cwd: str | None = None) -> Resolved:
    """explicit argument > PAPERWEIR_CONFIG and PAPERWEIR_LIBRARY_DIR > file > default."""
    env, home, cwd = os.environ if env is None else env, home or os.path.expanduser("~"), cwd or os.getcwd()
    named = config_path or env.get("PAPERWEIR_CONFIG")
    at = expand(named, cwd, home) if named else (expand(env["XDG_CONFIG_HOME"], cwd, home) if env.get("XDG_CONFIG_HOME") else Path(home) / ".config") / "paperweir" / "paperweir.json"
    config = read(at)
    explicit = library_dir or env.get("PAPERWEIR_LIBRARY_DIR")
    chosen = explicit or config.get("libraryDir")
    folder_ = expand(chosen, cwd if explicit else at.parent, home) if chosen else Path(home) / "Documents" / "paperweir"
    for section, defaults in DEFAULTS.items():
        if section in config:
            config[section] = {**defaults, **config[section]}
            if "smtp" in defaults:
                config[section]["smtp"] = {**defaults["smtp"], **config[section].get("smtp", {})}
    if vault := config.get("obsidian"):
        vault["vaultPath"] = str(expand(vault["vaultPath"], at.parent, home))
        vault.setdefault("vaultName", os.path.basename(vault["vaultPath"]))
    return Resolved(at, folder_, config)


def update(path: str | os.PathLike, section: str, value: Any) -> None:
    """Replace one section; the document is checked first and replaced by a rename."""
    config = check({**read(path), section: value})
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    tmp = f"{path}.{os.getpid()}.tmp"
    Path(tmp).write_text(json.dumps(config, indent=2) + "\n", encoding="utf-8")
    os.replace(tmp, path)
