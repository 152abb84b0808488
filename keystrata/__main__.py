"""python -m keystrata check|document|snapshot|terraform|request|lock SCHEMA [LOCK]
python -m keystrata check -policy POLICY SCHEMA
python -m keystrata diff OLD NEW

A schema is a file, or revision:file for what a file of a git repository held at a revision."""

from __future__ import annotations

import json
import sys

from keystrata.model import DesignError
from keystrata.operators import policy as policies
from keystrata.plans import changes, document

VERBS = ("check", "document", "snapshot", "terraform", "request", "lock", "diff")


def main(args: list[str]) -> int:
    verb, *rest = args or [""]
    rules = None
    try:
        if verb == "check" and len(rest) > 2 and rest[0] == "-policy":
            with open(rest[1], encoding="utf-8") as f:
                rules = policies.read_policy(f.read())
            rest = rest[2:]
        if verb not in VERBS or not rest or verb == "diff" and len(rest) != 2:
            print(__doc__)
            return 2
        design = changes.load_any(rest[-1] if verb == "diff" else rest[0])
        old = changes.load_any(rest[0]) if verb == "diff" else None
    except (DesignError, OSError) as err:
        print(err, file=sys.stderr)
        return 1
    if verb == "check":
        found = policies.check(design, rules)
        for f in found:
            print(f"{f.severity}: {f.rule}: {f.subject} {f.text}".rstrip())
        return int(policies.fails(found, rules))
    if verb == "lock":
        print("\n".join(document.write_lock(rest[1] if len(rest) > 1 else rest[0] + ".lock", design)))
        return 0
    if verb == "diff":
        print(changes.text(old, design))
        return 0
    print({"document": document.markdown, "snapshot": lambda d: json.dumps(document.snapshot(d), indent=1), "terraform": document.terraform, "request": document.create_request}[verb](design))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
