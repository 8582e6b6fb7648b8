"""python -m loomgraph REPO [RANGE]: the context of a change as Markdown or JSON."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.engine import ContextEngine, Options, compare_runs
from .sources import artifacts, git


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    p.add_argument("repo")
    p.add_argument("range", nargs="?", help="-N, END-N, START+N or A..B; by default the working tree against HEAD")
    p.add_argument("--config", help="a JSON file with options; the command line goes before it")
    p.add_argument("--output", default="context", help="path without extension")
    p.add_argument("--coverage", help="a Cobertura report")
    p.add_argument("--compile-commands", help="a compilation database")
    p.add_argument("--references", help="a resolver's callers: JSON lines with func, target, path, line_no, seq and code")
    p.add_argument("--compare", action="store_true", help="write the payload by lexical search and the one by --references")
    p.add_argument("--format", choices=("md", "json"))
    for name, kind in (("max-lines", int), ("max-mb", float), ("max-interface-depth", int), ("caller-depth", int), ("callee-depth", int), ("data-depth", int)):
        p.add_argument(f"--{name}", type=kind)
    for name in ("disable-pruning", "skip-ffi", "skip-macro-expansion"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    a = vars(p.parse_args(argv))
    repo, span, config, output = (a.pop(k) for k in ("repo", "range", "config", "output"))
    coverage, commands = a.pop("coverage"), a.pop("compile_commands")
    references, two = a.pop("references"), a.pop("compare")
    if two and not references:
        p.error("--compare needs --references")
    options = Options.from_sources(Path(config).read_text() if config else None, **a)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    start, end = git.resolve_range(repo, span) if span else (None, None)
    diff = git.diff(spark, repo, start, end)
    engine = ContextEngine(spark, git.snapshot(spark, repo, end), options)
    sources = {}
    if coverage:
        sources["coverage"] = artifacts.read_coverage(spark, coverage)
    if commands:
        sources["units"] = artifacts.read_commands(spark, commands)
    found = spark.read.schema("func string, target string, path string, line_no long, seq long, code string").json(references) if references else None
    if two:
        for name, text in zip(("lexical", "resolver"), compare_runs(engine, diff.select("text"), diff.first().raw, found, **sources)[:2], strict=True):
            Path(f"{output}_{name}.{options.format}").write_text(text, encoding="utf-8")
        return 0
    if found is not None:
        sources["references"] = found
    out = engine.run(diff.select("text"), diff.first().raw, **sources)
    Path(f"{output}_final.{options.format}").write_text(out, encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
