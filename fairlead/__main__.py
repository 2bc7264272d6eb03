"""python -m fairlead QUERY SF_DIR: run a query and show its rows; without arguments, list the queries."""

from __future__ import annotations

import sys

from fairlead.plans.queries import QUERIES
from fairlead.session import session


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return 0 if not args else 2
    QUERIES[args[0]](session(master="local[*]"), args[1]).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
