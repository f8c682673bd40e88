"""python -m tally verify|tip DIR [--json]: checks of the book that DIR's tables give, or the tips of its logs.

Exits with 1 if a check has findings.
"""

from __future__ import annotations

import argparse
import json
import sys

from tally.operators import verify
from tally.queries import QUERIES
from tally.session import local_session
from tally.sources.fixtures import Fixture


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tally")
    parser.add_argument("command", choices=["verify", "tip"])
    parser.add_argument("dir")
    parser.add_argument("--json", action="store_true")
    own = parser.parse_args(args)
    spark = local_session(app="tally")
    if own.command == "tip":
        rows = verify.tips(Fixture(spark, own.dir).logs).select("tip").orderBy("tip")
    else:
        rows = QUERIES["verify_all"](spark, own.dir)
    got = rows.collect()
    for r in got:
        print(json.dumps(r.asDict(), default=str) if own.json else "\t".join(map(str, r)))
    return int(own.command == "verify" and not all(r.ok for r in got))


if __name__ == "__main__":
    sys.exit(main())
