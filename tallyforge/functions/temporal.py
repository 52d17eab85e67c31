"""Time expressions of questions as ranges; nothing depends on the wall clock."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "|".join(m[:3] + f"(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS)


@dataclass(frozen=True)
class Period:
    kind: str
    low: date | None = None
    high: date | None = None
    sequences: tuple[int, ...] = ()

    def predicate(self, day: str, sequence: str | None = None) -> Column:
        """Rows of the period; a null date is never in a range."""
        out = F.lit(True)
        if self.low:
            out &= F.col(day) >= F.lit(self.low)
        if self.high:
            out &= F.col(day) <= F.lit(self.high)
        if self.sequences and sequence:
            out &= F.col(sequence).isin(*self.sequences)
        return out


def parse(question: str) -> Period:
    """Sequence numbers, ISO days, ranges and bounds of years, quarters, months, years, latest; else ALL."""
    q = question.lower()
    if m := re.search(r"\breports?\s+(\d+)\s*(?:to|-|through)\s*(\d+)", q):
        return Period("SEQUENCES", sequences=tuple(range(int(m[1]), int(m[2]) + 1)))
    if found := re.findall(r"\breports?\s+(?:no\.?\s*)?(\d+)", q):
        return Period("SEQUENCES", sequences=tuple(map(int, found)))
    if m := re.search(r"\b(\d{4})-(\d\d)-(\d\d)\b", q):
        day = date(*map(int, m.groups()))
        return Period("SINCE", low=day) if re.search(r"\b(since|after|from)\b", q) else Period("UNTIL", high=day) if re.search(r"\b(before|until|by)\b", q) else Period("DAY", day, day)
    if m := re.search(r"\b(?:between|from)\s+(\d{4})\s+(?:and|to)\s+(\d{4})", q):
        return Period("RANGE", date(int(m[1]), 1, 1), date(int(m[2]), 12, 31))
    if m := re.search(r"\b(?:since|after)\s+(\d{4})\b", q):
        return Period("SINCE", low=date(int(m[1]) + ("after" in m[0]), 1, 1))
    if m := re.search(r"\b(?:before|until)\s+(\d{4})\b", q):
        return Period("UNTIL", high=date(int(m[1]) - ("before" in m[0]), 12, 31))
    if m := re.search(r"\bq([1-4])\s+(\d{4})\b", q):
        k, y = int(m[1]), int(m[2])
        return Period("QUARTER", date(y, 3 * k - 2, 1), date(y, 3 * k, monthrange(y, 3 * k)[1]))
    if m := re.search(rf"\b({_MONTH})\s+(\d{{4}})\b", q):
        k = next(i for i, n in enumerate(MONTHS, 1) if n.startswith(m[1][:3]))
        return Period("MONTH", date(int(m[2]), k, 1), date(int(m[2]), k, monthrange(int(m[2]), k)[1]))
    if re.search(r"\b(latest|current|most recent|last report)\b", q):
        return Period("LATEST")
    if m := re.search(r"\b(?:in|during)\s+(\d{4})\b", q):
        return Period("YEAR", date(int(m[1]), 1, 1), date(int(m[1]), 12, 31))
    return Period("ALL")
