"""Named queries from layered TOML files, and their expansion."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .query import QueryError, parse

#: The configuration file looked for from a directory upwards, and the version it may state.
CONFIG_NAME, SCHEMA_VERSION = ".quarry.toml", 1
#: A user's own file, read before all others.
GLOBAL_CONFIG = Path.home() / ".config" / "quarry" / "config.toml"


@dataclass(frozen=True)
class Preset:
    name: str
    query: str
    description: str = ""
    tags: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    includes: tuple[str, ...] = ()
    source: str = ""


@dataclass
class Presets:
    named: dict[str, Preset] = field(default_factory=dict)
    diagnostics: list[str] = field(default_factory=list)

    def add_text(self, text: str, source: str = "") -> Presets:
        """Entries of a file; those of the same name are replaced."""
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise QueryError(f"Invalid configuration {source}: {e}") from e
        version = data.get("schema_version")
        if version is not None and version != SCHEMA_VERSION:
            self.diagnostics.append(f"{source}: schema_version {version} is not {SCHEMA_VERSION}")
        for name, entry in data.get("presets", {}).items():
            entry = {"query": entry} if isinstance(entry, str) else entry
            includes = entry.get("includes") or entry.get("extends") or entry.get("presets") or ()
            self.named[name] = Preset(name, entry.get("query", ""), entry.get("description", ""), tuple(entry.get("tags", ())), tuple(entry.get("examples", ())), (includes,) if isinstance(includes, str) else tuple(includes), source)
        return self

    def resolve(self, name: str, above: tuple[str, ...] = ()) -> str:
        """The preset's query with those it includes before it."""
        if name in above:
            raise QueryError(f"Preset cycle: {' -> '.join((*above, name))}")
        if name not in self.named:
            raise QueryError(f"Unknown preset: '{name}'")
        preset = self.named[name]
        parts = [self.resolve(x, (*above, name)) for x in preset.includes]
        if preset.query.strip():
            parse(preset.query)
            parts.append(preset.query)
        if not parts:
            raise QueryError(f"Preset '{name}' has no query")
        return parts[0] if len(parts) == 1 else " & ".join(f"({p})" for p in parts)


def load(start: str | Path, global_file: str | Path | None = None) -> Presets:
    """A global file, then the nearest file from ``start`` upwards."""
    out = Presets()
    global_file = GLOBAL_CONFIG if global_file is None else global_file
    if global_file and Path(global_file).is_file():
        out.add_text(Path(global_file).read_text(), str(global_file))
    where = Path(start).resolve()
    for d in (where, *where.parents):
        if (d / CONFIG_NAME).is_file():
            return out.add_text((d / CONFIG_NAME).read_text(), str(d / CONFIG_NAME))
    return out


def effective_query(text: str, names: tuple[str, ...], presets: Presets) -> str:
    if not names:
        return text
    joined = " & ".join(f"({presets.resolve(n)})" for n in names)
    return f"({joined}) & ({text})" if text.strip() else joined
