"""Rules and settings: small driver-side state, kept as JSON beside what it rules."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

#: Formats that a note's rule may ask for.
OUTPUTS = ("pdf", "svg", "png", "xopp", "inkml")


class BadSetting(ValueError):
    pass


@dataclass
class Rule:
    blocked: bool = False
    allowed: bool = False
    name: str = ""
    folder: str = ""
    format: str = ""


@dataclass
class Rules:
    mode: str = "blocklist"
    notes: dict[str, Rule] = field(default_factory=dict)
    folders: dict[str, Rule] = field(default_factory=dict)

    def set_mode(self, mode: str) -> None:
        if mode not in ("blocklist", "allowlist"):
            raise BadSetting(f"mode {mode!r}")
        self.mode = mode

    def set_note(self, key: str, **changes) -> None:
        """Change a note's rule; a rule that says nothing is removed."""
        if changes.get("format") and changes["format"] not in OUTPUTS:
            raise BadSetting(f"format {changes['format']!r}")
        _change(self.notes, key, {f.name for f in fields(Rule)}, changes)

    def set_folder(self, key: str, **changes) -> None:
        """As `set_note`, but a folder is only blocked or allowed."""
        _change(self.folders, key, {"blocked", "allowed"}, changes)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Notes' and folders' rules as tables, for the decision."""
        rule = "key string, blocked boolean, allowed boolean, name string, folder string, format string"
        rows = [(k, *asdict(r).values()) for k, r in self.notes.items()]
        return spark.createDataFrame(rows, rule), spark.createDataFrame([(k, r.blocked, r.allowed) for k, r in self.folders.items()], "folder string, blocked boolean, allowed boolean")


def _change(rules: dict[str, Rule], key: str, known: set[str], changes: dict) -> None:
    unknown = changes.keys() - known
    if unknown:
        raise BadSetting(f"unknown {', '.join(sorted(unknown))}")
    changed = Rule(**(asdict(rules.get(key, Rule())) | changes))
    if changed == Rule():
        rules.pop(key, None)
    else:
        rules[key] = changed


def save(rules: Rules, path: str) -> None:
    """Written beside and then renamed, so a reader sees the old file or the new one."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(asdict(rules), f, indent=1, sort_keys=True)
    os.replace(part, path)


def load(path: str) -> Rules:
    """The rules at ``path``; a missing file gives defaults, and a broken one is moved aside first."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        return Rules(raw["mode"], *({k: Rule(**r) for k, r in raw[part].items()} for part in ("notes", "folders")))
    except FileNotFoundError:
        return Rules()
    except (ValueError, KeyError, TypeError, AttributeError):
        os.replace(path, f"{path}.broken")
        return Rules()
