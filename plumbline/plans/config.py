"""An entry in a JSON settings file, so that other programs find the command line.

    python -m plumbline.plans.config settings.json servers plumbline '{"command": "spark-submit"}'
"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path


def upsert(path: str | Path, section: str, name: str, entry: dict) -> None:
    """Sets one entry of a section and leaves the rest of the file as it is; a missing file or section
    is made.  The file is replaced in one step.  What is no JSON object raises ValueError and stays."""
    path = Path(path)
    settings = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}  # JSONDecodeError is a ValueError
    if not isinstance(settings, dict) or not isinstance(settings.setdefault(section, {}), dict):
        raise ValueError(f"{path} holds no JSON object where {section} belongs")
    settings[section][name] = entry
    draft = path.with_name(f"{path.name}.{os.getpid()}.draft")
    draft.write_text(json.dumps(settings, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    draft.replace(path)


def main(args: list[str]) -> int:
    try:
        path, section, name, entry = args
        upsert(path, section, name, json.loads(entry))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
