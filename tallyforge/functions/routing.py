"""From a question to what may be read: validation, mentions, intents and decisions. Small rules on one question."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

LONGEST = 2000


class QuestionError(ValueError):
    pass


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    value: str


def validated(question: str) -> str:
    """NFKC, printable, not blank and not too long."""
    text = " ".join(unicodedata.normalize("NFKC", question).split())
    if not text or len(text) > LONGEST or not text.isprintable():
        raise QuestionError("a question is 1 to 2,000 printable characters")
    return text


def mentions(question: str, names: dict[str, str]) -> list[Mention]:
    """Names of entities in a question, the longest first, none inside another; ``names``: name to id."""
    found: list[Mention] = []
    for name in sorted(names, key=lambda n: (-len(n), n)):
        for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", question, re.IGNORECASE):
            if all(m.end() <= x.start or m.start() >= x.end for x in found):
                found.append(Mention(m.start(), m.end(), names[name]))
    return sorted(found, key=lambda x: x.start)


def resolved(question: str, names: dict[str, str], active: str | None, authorized: set[str]) -> tuple[str, str | None]:
    """(status, id): what is named wins over what is active; several, foreign or none are refused by name."""
    ids = {m.value for m in mentions(question, names)}
    if len(ids) > 1:
        return "AMBIGUOUS", None
    chosen = next(iter(ids), active)
    if chosen is None:
        return "MISSING", None
    return ("RESOLVED", chosen) if chosen in authorized else ("FORBIDDEN", None)


def intents(question: str, rules: dict[str, str]) -> list[str]:
    """Intents whose pattern matches, without those whose match lies inside another's longer one, in the rules' order."""
    spans = [(name, m.start(), m.end()) for name, p in rules.items() if (m := re.search(p, question, re.IGNORECASE))]
    inside = lambda a, b: b[1] <= a[1] and a[2] <= b[2] and b[2] - b[1] > a[2] - a[1]
    return [a[0] for a in spans if not any(inside(a, b) for b in spans)]


def decision(status: str, found: list[str], plain: set[str]) -> tuple[str, str]:
    """(route, reason): refuse, clarify, read directly, or investigate."""
    if status != "RESOLVED":
        return ("REFUSE", status) if status == "FORBIDDEN" else ("CLARIFY", status)
    if not found:
        return "INVESTIGATE", "NO_INTENT"
    return ("DIRECT", "PLAIN") if set(found) <= plain else ("INVESTIGATE", "COMPOSITE")
