"""Keyset pages with opaque cursors: a cursor carries its filter, so a page that follows needs nothing else."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row

from tally.operators.book import page

DEFAULT, MOST = 25, 100


@dataclass(frozen=True)
class Cursor:
    """Where a page begins (behind the position `after`), what it is a page of, and its length."""

    after: tuple | None = None
    filter: tuple[tuple[str, str], ...] = ()
    limit: int = DEFAULT

    def __post_init__(self):
        if not 1 <= self.limit <= MOST:
            raise ValueError(f"limit must be 1 to {MOST}")

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps(asdict(self), separators=(",", ":")).encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            own = json.loads(base64.b64decode(text + "=" * (-len(text) % 4), b"-_", validate=True))
            return Cursor(None if own["after"] is None else tuple(own["after"]), tuple((str(k), str(v)) for k, v in own["filter"]), int(own["limit"]))
        except (binascii.Error, ValueError, KeyError, TypeError) as e:
            raise ValueError("not a cursor") from e


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next: str | None


def pages(df: DataFrame, order: list[str], cursor: str | None = None, filter: dict[str, str] | None = None, limit: int = DEFAULT, apply: Callable[[DataFrame, dict[str, str]], DataFrame] | None = None) -> Page:
    """One page of df in `order`, and the cursor of the next if there is one (one row more is asked for to know).

    With a cursor, its filter and limit count and the caller's are ignored. `apply` narrows df by the filter.
    """
    c = Cursor.decode(cursor) if cursor else Cursor(None, tuple(sorted((filter or {}).items())), limit)
    rows = apply(df, dict(c.filter)) if apply else df
    got = page(rows, order, c.after, c.limit, more=1).collect()
    more = None
    if len(got) > c.limit:
        last = got[c.limit - 1]
        more = Cursor(tuple(v if isinstance(v := last[k], int) else str(v) for k in order), c.filter, c.limit).encode()
    return Page(got[: c.limit], more)
