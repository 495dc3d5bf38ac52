"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Every rule is a glob.  The states of all globs lie side by side in one bit
vector of several 64-bit words; one step of the Shift-And scheme moves all of
them by one byte of the URL::

    state = (state << 1 | carry) & enter[byte]  |  state & stay[byte]

``enter[byte]`` holds the states whose pattern character accepts the byte;
``stay[byte]`` holds the states behind a ``*`` (any byte) and, on the later
bytes of a character, those of a ``?``.  The URLs of a batch take each step
together, longest first, so that a finished one costs nothing more.

The canonical URL is ``.host``, the byte 0xFF, which no text contains, and the
path.  A host rule is therefore ``*.host`` + 0xFF + ``path*`` and cannot match
inside a path; host and path of a rule may hold ``*`` and ``?`` (a backslash
takes the next character as it is).

A list rule decides where one fits, the longest first.  Elsewhere the method's
own globs decide: a URL that one of them matches is blocked, any other allowed.
The state vector grows with the summed length of the rules, so the rule list is
a parameter for thousands of rules, not millions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The list rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Own list of the method: globs of a host and of the beginning of a path whose pages are blocked where no list rule fits.
BLOCKED = [
    ("*spam*", ""), ("*casino*", ""), ("*viagra*", ""), ("*pills*", ""), ("*porn*", ""),
    ("*warez*", ""), ("*adserver*", ""), ("*", "/wp-admin/"), ("*", "*/cgi-bin/"),
]

_MARK = 0xFF


def glob_tokens(glob: str) -> list[int | str]:
    """Bytes of the literals, ``"?"`` and ``"*"`` of a glob; a backslash makes the next character a literal."""
    out: list[int | str] = []
    chars = iter(glob)
    for c in chars:
        if c == "\\":
            out += next(chars, "\\").encode()
        elif c in "*?":
            out.append(c)
        else:
            out += c.encode()
    return out


def rule_tokens(host: str, path: str) -> list[int | str]:
    """The glob of a rule that fits a host, all its subdomains and all paths that start with ``path``."""
    return ["*", ord("."), *glob_tokens(host), _MARK, *glob_tokens(path), "*"]


class Automaton:
    """All patterns (token lists) as masks of one multiword state vector."""

    def __init__(self, patterns: Sequence[Sequence[int | str]]):
        places, at = [], 0
        for tokens in patterns:
            places.append(at)
            at += 1 + sum(t != "*" for t in tokens)
        self.words = max(1, (at + 63) // 64)
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        for state, tokens in zip(places, patterns):
            self._set(self.start, state)
            for t in tokens:
                if t == "*":
                    self._set(self.stay, state, slice(None))
                    continue
                state += 1
                if t == "?":
                    self._set(self.enter, state, slice(0, 0x80))
                    self._set(self.enter, state, slice(0xC0, 0xF8))
                    self._set(self.stay, state, slice(0x80, 0xC0))
                else:
                    self._set(self.enter, state, t)
            self.ends.append((state // 64, np.uint64(state % 64)))

    @staticmethod
    def _set(table: np.ndarray, state: int, rows=None) -> None:
        bit = np.uint64(1 << state % 64)
        if rows is None:
            table[state // 64] |= bit
        else:
            table[rows, state // 64] |= bit

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix (text, pattern): whether the pattern matches the whole text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        begin, sizes = (ends - sizes)[order], sizes[order]
        states = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        for at in range(int(sizes[0]) if live else 0):
            while sizes[live - 1] <= at:
                live -= 1
            state, byte = states[:live], flat[begin[:live] + at]
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            states[:live] = moved & self.enter[byte] | state & self.stay[byte]
        hits = np.zeros((len(texts), len(self.ends)), bool)
        for p, (word, bit) in enumerate(self.ends):
            hits[order, p] = (states[:, word] >> bit & np.uint64(1)).astype(bool)
        return hits


def precedence(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Rules in the order in which they win: the longest first, then the longer host, then block before allow."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1], r[2]))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower()), path


def _judge(rules, blocked):
    ordered = precedence(rules)
    names = [host + path for _, host, path in ordered]
    verdicts = [verdict for verdict, _, _ in ordered]

    def run(batches):
        machine = Automaton([rule_tokens(h, p) for _, h, p in ordered] + [rule_tokens(h, p) for h, p in blocked])
        for batch in batches:
            urls = [b"." + h.encode("utf-8", "surrogatepass") + bytes([_MARK]) + p.encode("utf-8", "surrogatepass")
                    for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            hits = machine.matches(urls)
            rule, verdict, glob = [], [], []
            for row in hits:
                found = np.flatnonzero(row)
                best = int(found[0]) if len(found) else None
                listed = best is not None and best < len(ordered)
                rule.append(names[best] if listed else None)
                verdict.append(verdicts[best] if listed else "allow" if best is None else "block")
                glob.append(None if best is None or listed else "".join(blocked[best - len(ordered)]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.string()) for c in (rule, verdict, glob))],
                names=[*batch.schema.names, "rule", "verdict", "glob"])
    return run


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
                 blocked: Sequence[tuple[str, str]] = BLOCKED, url: str = "url", key: str = "page_id") -> DataFrame:
    """``key, host, path, rule, verdict, glob`` for every row of ``pages``.

    ``rule`` is the list rule that decided (null: none fits), ``glob`` the own
    glob that blocked where no rule fits.  A null or empty URL, or one without
    ``://``, has empty host and path and is allowed; repeated rows and ids each
    get their verdict; very long URLs are read to their end; an empty table
    gives no rows; other columns play no part.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_judge(list(rules), list(blocked)),
                           f"`{key}` {kind}, host string, path string, rule string, verdict string, glob string")
