"""Command line: index a repository and report its similar functions as JSON.

    spark-submit plumbline/plans/report.py /path/to/repository [--index-dir DIR] [--threshold 0.85]
"""

from __future__ import annotations

import argparse
import json
import sys

from plumbline.plans.operations import Engine
from plumbline.session import session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("root")
    parser.add_argument("--index-dir")
    parser.add_argument("--threshold", type=float, default=0.85)
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--min-lines", type=int, default=4)
    parser.add_argument("--force", action="store_true")
    o = parser.parse_args(args)
    engine = Engine(session())
    try:
        indexed = engine.index_repository(o.root, o.index_dir, o.force).head().asDict()
        pairs = engine.analyze_project(o.index_dir, o.threshold, o.top_k, o.min_lines)
        total = engine.index(o.index_dir).methods().count()
        found = [json.loads(r) for r in pairs.toJSON().collect()]
    except (NotADirectoryError, ValueError) as e:
        print(json.dumps({"error": str(e)}))
        return 1
    print(json.dumps({"repository_root": o.root, "index": indexed, "analysis": {"total_methods": total, "similar_pairs": found}}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
