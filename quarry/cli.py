"""Command line: search, query introspection, presets and languages.

    python -m quarry.cli search "ext:rs & func:main" --root src --format hunks
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quarry.capture.profiles import sql_dialect
from quarry.engine import Engine, Options
from quarry.operators import formats
from quarry.plans import query as Q
from quarry.plans.explain import explain, lint_query, why_file, why_no_results
from quarry.plans.presets import load
from quarry.request import capabilities, describe, languages, predicate_catalog


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry")
    commands = top.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="print matching files")
    query = commands.add_parser("query", help="look at a query without, or before, running it")
    query.add_argument("action", choices=("validate", "normalize", "ast", "explain", "lint", "reference", "why-no-results", "why-file", "dialect"))
    for p in (search, query):
        p.add_argument("text", nargs="?", default="")
        p.add_argument("--root", default=".")
        p.add_argument("--preset", action="append", default=[])
        p.add_argument("--hidden", action="store_true")
        p.add_argument("--no-ignore", action="store_true")
        p.add_argument("--max-depth", type=int, default=100)
        p.add_argument("--match-mode", default="exact", choices=("exact", "case_insensitive", "prefix", "regex", "wildcard"))
        p.add_argument("--language")
        p.add_argument("--sql-dialect")
        p.add_argument("--error-mode", default="skip_errors", choices=("skip_errors", "fail_fast"))
        p.add_argument("--semantic-strict", action="store_true")
    query.add_argument("--file", default="")
    search.add_argument("--format", default="hunks", choices=formats.FORMATS)
    search.add_argument("--limit", type=int, default=1000, help="files of a page; the next one is asked for with --offset")
    search.add_argument("--offset", type=int, default=0)
    search.add_argument("--context", type=int, default=2)
    search.add_argument("--line-numbers", action="store_true")
    search.add_argument("--time", default="utc", choices=("utc", "local", "iso", "unix"))
    search.add_argument("--output")
    lang = commands.add_parser("lang", help="languages and what their keys capture")
    lang.add_argument("action", choices=("list", "describe", "keys", "matrix"))
    lang.add_argument("word", nargs="?", default="")
    preset = commands.add_parser("preset", help="named queries")
    preset.add_argument("action", choices=("list", "show", "describe"))
    preset.add_argument("word", nargs="?", default="")
    preset.add_argument("--root", default=".")
    config = commands.add_parser("config", help="the configuration files in use")
    config.add_argument("action", choices=("path", "show", "validate", "limits"))
    config.add_argument("--root", default=".")
    return top


def _lang(a) -> str:
    if a.action in ("list", "describe"):
        return json.dumps(languages() if a.action == "list" else describe(a.word), indent=2)
    by = {x["id"]: x["keys"] for x in languages()}
    if a.action == "keys":
        return "\n".join(sorted({k for keys in by.values() for k in keys}))
    return "\n".join(f"{name}\t{' '.join(keys)}" for name, keys in sorted(by.items()))


def _preset(a) -> str:
    presets = load(a.root)
    if a.action == "list":
        return "\n".join(sorted(presets.named))
    if a.action == "show":
        return presets.resolve(a.word)
    if a.word not in presets.named:
        raise Q.QueryError(f"Unknown preset: '{a.word}'")
    p = presets.named[a.word]
    return json.dumps({"name": p.name, "query": p.query, "description": p.description, "tags": p.tags, "examples": p.examples, "includes": p.includes, "source": p.source}, indent=2)


def _config(a) -> str:
    presets = load(a.root)
    if a.action == "path":
        return "\n".join(sorted({p.source for p in presets.named.values()}))
    if a.action == "limits":
        return json.dumps(capabilities()["limits"], indent=2)
    if a.action == "validate":
        for name in presets.named:
            presets.resolve(name)
        return "\n".join(presets.diagnostics) or "valid"
    return "\n".join(f"{n} = {p.query}" for n, p in sorted(presets.named.items()))


def _search(a, spark):
    from quarry.sources.files import directory

    corpus = directory(spark, a.root, a.hidden, a.no_ignore, a.max_depth)
    options = Options(presets=tuple(a.preset), semantic_match=a.match_mode, language=a.language, sql_dialect=a.sql_dialect, error_mode=a.error_mode, semantic_strict=a.semantic_strict, known_presets=load(a.root))
    return Engine(spark, corpus, options).search(a.text)


def _query(a, session) -> str:
    match a.action:
        case "validate":
            for p in Q.predicates(Q.parse(a.text)):
                if p.key not in Q.KEYS:
                    raise Q.QueryError(f"Unknown predicate key: '{p.key}'")
            return "valid"
        case "normalize":
            return Q.normalize(a.text)
        case "ast":
            return json.dumps(Q.stable(Q.parse(a.text)), indent=2)
        case "lint":
            return "\n".join(lint_query(a.text))
        case "reference":
            return "\n".join(f"{x['key']}\t{x['class']}" for x in predicate_catalog())
        case "dialect":
            return "\t".join(sql_dialect(Path(a.file).read_text(errors="replace")))
        case "explain":
            return json.dumps(explain(_search(a, session()), a.text), indent=2)
        case "why-no-results":
            return why_no_results(_search(a, session()))
        case _:
            return json.dumps(why_file(_search(a, session()), a.file))


def run(argv: list[str], session) -> str:
    """``session``: makes a Spark session when one is needed."""
    a = parser().parse_args(argv)
    if a.command == "search":
        text = formats.render(_search(a, session()), a.format, a.limit, a.offset, a.context, a.line_numbers, a.time)
        if a.output:
            Path(a.output).write_text(text)
            return ""
        return text
    if a.command == "query":
        return _query(a, session)
    return {"lang": _lang, "preset": _preset, "config": _config}[a.command](a)


def main() -> int:
    from pyspark.sql import SparkSession

    try:
        print(run(sys.argv[1:], lambda: SparkSession.builder.master("local[*]").config("spark.ui.showConsoleProgress", "false").getOrCreate()))
    except Q.QueryError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
