"""Operator 10: URL filters by a bit-parallel wildcard automaton.

Every glob is a run of positions in one long bit string, packed into 64-bit words: a position for each literal symbol,
and a self-loop on the position before a star. One Shift-And step moves the states of all globs on by one symbol, and
numpy takes that step for all URLs of a batch together. The alphabet is the bytes of the canonical URL and one border
symbol between host and path, so a host's star never reaches into a path.

A rule (host, path) fits its host, all its subdomains and every path that begins with its own; the longest that fits
decides. Where no rule does, the method's own globs of unwanted hosts and paths decide, and else the URL is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed values of the query's contract: (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: The method's own list, as globs of the host and of the path: advertising, tracking, gambling, spam and adult hosts.
BLOCKED_HOSTS = (
    "ads.*", "*.ads.*", "ads-*", "*.ads-*", "*-ads.*", "ad.*", "*.ad.*", "adserver*", "*.adserver*", "*doubleclick.*", "*adsense*", "*banner*",
    "track.*", "*.track.*", "*tracker*", "*-track.*", "*tracking*", "*analytics.*", "*pixel.*", "*telemetry*", "*beacon.*", "*clickbait*",
    "*casino*", "*poker*", "*free-bets*", "*freebets*", "*betting*", "*gambl*", "*jackpot*", "*slots-*", "*lottery*",
    "*cheap-pills*", "*pills.*", "*viagra*", "*cialis*", "*pharma-*", "*payday*", "*loan-shark*", "*get-rich*", "*free-money*",
    "*porn*", "*xxx*", "*sex-*", "*escort*", "*malware*", "*phish*", "*warez*", "*torrent*",
)
BLOCKED_PATHS = ("*/ads/*", "*/adserv*", "*/banner/*", "*/popup/*", "*/track/*", "*/pixel.gif*", "*/wp-login*", "*/xmlrpc*", "*/cgi-bin/*", "*/casino/*", "*/affiliate/*")
_BORDER, _END = 256, 257


class Automaton:
    """All globs at once. A glob is a tuple of symbols; None stands for any run of symbols but the border, and
    ``ANY`` for any run at all."""

    ANY = "any"

    def __init__(self, globs: list[tuple]) -> None:
        starts, accepts, loops, plain, literals = [], [], [], [], []
        bit = 0
        for g in globs:
            starts.append(bit)
            for x in g:
                if x is None:
                    loops.append(bit)
                elif x == Automaton.ANY:
                    plain.append(bit)
                else:
                    bit += 1
                    literals.append((bit, x))
            accepts.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        self.start, self.accepts = self._mask(starts), accepts
        inside, anywhere = self._mask(loops), self._mask(plain)
        self.on = np.zeros((258, self.words), dtype=np.uint64)
        for at, x in literals:
            self.on[x, at // 64] |= np.uint64(1 << at % 64)
        self.stay = np.tile(inside | anywhere, (258, 1))
        self.stay[_BORDER] = anywhere

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def matches(self, texts: list[list[int]]) -> np.ndarray:
        """A boolean for each text (a list of symbols) and glob: whether the glob matches the whole text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        state = np.tile(self.start, (len(texts), 1))
        flat = np.fromiter((x for i in order for x in texts[i]), dtype=np.int64, count=int(lengths.sum()))
        offset = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else lengths
        top, one = np.uint64(63), np.uint64(1)
        for at in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -at, side="left"))
            s, x = state[:live], flat[offset[:live] + at]
            shifted = s << one
            if self.words > 1:
                shifted[:, 1:] |= s[:, :-1] >> top
            state[:live] = (shifted & self.on[x]) | (s & self.stay[x])
        hit = np.stack([(state[:, a // 64] >> np.uint64(a % 64)) & one for a in self.accepts], axis=1).astype(bool) if len(self.accepts) else np.zeros((len(texts), 0), dtype=bool)
        out = np.empty_like(hit)
        out[order] = hit
        return out


def _symbols(glob: str) -> list:
    return [None if x == "*" else x for part in glob.split("*") for x in [*part.encode(), "*"]][:-1]


def rule_globs(rule: str) -> list[tuple]:
    """A rule's globs over host, border and path: the host itself, and any subdomain."""
    host, _, path = rule.partition("/")
    tail = [*host.encode(), _BORDER, *(f"/{path}".encode() if "/" in rule else b""), Automaton.ANY]
    return [tuple(tail), (None, ord("."), *tail)]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; without "://", or null: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, hosts: tuple[str, ...] = BLOCKED_HOSTS, paths: tuple[str, ...] = BLOCKED_PATHS) -> DataFrame:
    """(page_id, host, path, rule, verdict, reason) for every row of ``pages`` (page_id, url).

    A null or malformed URL has an empty host and path and is allowed; ties of equally long rules go to the earlier one;
    repeated rows are judged each; URLs may be of any length; an empty table gives no rows; other columns are not looked at.
    """
    globs, owner = [], []
    for i, (_, rule) in enumerate(rules):
        for g in rule_globs(rule):
            globs.append(g)
            owner.append(i)
    n_rules = len(globs)
    globs += [(*_symbols(h), _BORDER, Automaton.ANY) for h in hosts]
    globs += [(Automaton.ANY, _BORDER, *(Automaton.ANY if x is None else x for x in _symbols(p))) for p in paths]
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    names = [*hosts, *paths]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)
        for whole in batches:
            for start in range(0, len(whole), 4096):
                b = whole.iloc[start : start + 4096]
                texts = [[*h.encode("utf-8", "surrogatepass"), _BORDER, *p.encode("utf-8", "surrogatepass")] for h, p in zip(b["host"], b["path"], strict=True)]
                hit = automaton.matches(texts)
                fits = np.zeros((len(b), len(rules)), dtype=bool)
                for g, i in enumerate(owner):
                    fits[:, i] |= hit[:, g]
                chosen = [next((i for i in rank if row[i]), -1) for row in fits]
                own = hit[:, n_rules:]
                first = np.where(own.any(axis=1), own.argmax(axis=1), -1) if own.shape[1] else np.full(len(b), -1)
                rule = [rules[i][1] if i >= 0 else None for i in chosen]
                verdict = [rules[i][0] if i >= 0 else "block" if f >= 0 else "allow" for i, f in zip(chosen, first, strict=True)]
                reason = [rules[i][1] if i >= 0 else names[f] if f >= 0 else None for i, f in zip(chosen, first, strict=True)]
                yield pd.DataFrame({"page_id": b["page_id"], "host": b["host"], "path": b["path"], "rule": rule, "verdict": verdict, "reason": reason})

    host, path = parts(F.col("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string, reason string")
