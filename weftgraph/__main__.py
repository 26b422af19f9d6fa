"""Command line: scan a tree or repository into a store, clear a project, validate a tree."""

from __future__ import annotations

import argparse
import sys

from weftgraph.api import GraphApi
from weftgraph.session import build_session
from weftgraph.sources.detect import detect_tree
from weftgraph.sources.git import is_git_url
from weftgraph.sources.tree import EXCLUDES, ScanConfig
from weftgraph.store import GraphStore


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("store")
    scan.add_argument("path")
    scan.add_argument("--project", required=True)
    scan.add_argument("--name")
    scan.add_argument("--languages", default="")
    scan.add_argument("--exclude", default="")
    scan.add_argument("--no-tests", action="store_true")
    scan.add_argument("--max-depth", type=int)
    scan.add_argument("--clear", action="store_true")
    scan.add_argument("--analyze", action="store_true")
    scan.add_argument("--output", help="file for the report")
    clear = sub.add_parser("clear")
    clear.add_argument("store")
    clear.add_argument("--project")
    check = sub.add_parser("validate")
    check.add_argument("path")
    a = p.parse_args(argv)
    spark = build_session(master=a.master or None)
    if a.command == "validate":
        found = detect_tree(spark, ScanConfig(a.path, "check"))
        print("valid" if found["valid"] else "invalid", ", ".join(found["languages"]), *found["suggestions"], sep="\n")
        return 0 if found["valid"] else 1
    store = GraphStore(spark, a.store)
    store.initialize()
    if a.command == "clear":
        store.clear(a.project)
        return 0
    api = GraphApi(store)
    if is_git_url(a.path):
        out = api.scan_remote_repo(a.path, project=a.project)
    else:
        langs = tuple(x for x in a.languages.split(",") if x)
        config = ScanConfig(a.path, a.project, exclude_paths=(*EXCLUDES, *(x for x in a.exclude.split(",") if x)), include_tests=not a.no_tests, max_depth=a.max_depth, project_name=a.name, **({"languages": langs} if langs else {}))
        out = api.scan_dir(config, a.clear)
    text = str(out["report"])
    if a.analyze:
        text += "\nIssues:\n" + "".join(f"  {r['severity']}: {r['description']}\n" for r in api.find_architectural_issues(a.project).orderBy("severity", "entity").limit(5).collect())
    print(text)
    if a.output:
        with open(a.output, "w") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
