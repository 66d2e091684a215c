"""python -m lodestar TOOL PATH [name=value ...]: prints a tool's result. Exit 0: done; 2: the tool failed; 1: it can't be called so."""

from __future__ import annotations

import json
import sys

from . import tools
from .session import local_session


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[0] not in tools.TOOLS:
        print(f"{__doc__}\nTools: {', '.join(sorted(tools.TOOLS))}", file=sys.stderr)
        return 1
    given = {k: value(v) for k, _, v in (a.partition("=") for a in argv[2:])}
    out = tools.call(local_session("lodestar"), argv[0], path=argv[1], **given)
    print(json.dumps(out, ensure_ascii=False), file=sys.stdout if out["ok"] else sys.stderr)
    return 0 if out["ok"] else 1 if out["error"]["code"] == "VALIDATION_ERROR" else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
