"""URL filter: glob rules run as one bit-parallel wildcard automaton.

Every rule is packed into the words of a Shift-And mask.  A batch of canonical URLs is read
byte by byte, column by column, and one shift, one AND and one OR per machine word advance
all rules for all URLs of the batch at once.

A canonical URL is ``"." + host``, a separator byte that UTF-8 never holds, and the path.
Bit ``i`` of a rule says that its first ``i`` tokens are matched; ``*`` is a self-loop of the
bit before it, in the host part on all bytes but the separator.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and
the default verdict.  Rows come back one for one, repeated ones included; whole URLs are read,
whatever their length; an empty table gives no rows.  Of rules that fit, the longest wins, then the one listed first.
Columns of the input that carry the name of an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

SEPARATOR = 0xFF
_ANY = (1 << 256) - 1
_HOST = _ANY & ~(1 << SEPARATOR)

#: Host and path-prefix rules: (verdict, rule).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: The method's own globs, consulted where no rule fits: ``*`` any run, ``?`` any one byte.
GLOBS = (
    ("block", "*casino*/*"),
    ("block", "*free-bets*/*"),
    ("block", "*cheap-pills*/*"),
    ("block", "*/*/login*"),
    ("block", "*/*.exe"),
    ("allow", "blog.*/*"),
)

_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; both empty where it is null or has no ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_ASCII), path


def _tokens(host: str, path: str, prefix: bool) -> list[tuple[int, bool, int]]:
    """(bytes accepted as a 256-bit set, is a star, bytes of the star) of one pattern."""
    out: list[tuple[int, bool, int]] = [(0, True, _HOST)]
    for part, any_byte in ((f".{host}", _HOST), (None, 0), (path + "*" * prefix, _ANY)):
        if part is None:
            out.append((1 << SEPARATOR, False, 0))
            continue
        for ch in part.encode():
            if ch == ord("*"):
                out.append((0, True, any_byte))
            elif ch == ord("?"):
                out.append((any_byte, False, 0))
            else:
                out.append((1 << ch, False, 0))
    return out


@dataclass
class WildcardAutomaton:
    """All patterns in one multiword Shift-And automaton.

    ``step[c]`` holds the bits that may be entered on byte ``c``, ``stay[c]`` those that
    persist on it; ``start`` and ``last`` mark each pattern's first and accepting bit.
    """

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    last: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def build(cls, patterns: Sequence[list[tuple[int, bool, int]]]) -> WildcardAutomaton:
        at, last, enter, loop, start = 0, [], [], [], []
        for tokens in patterns:
            start.append(at)
            bit = at
            for accepts, star, bytes_ in tokens:
                if star:
                    loop.append((bit, bytes_))
                else:
                    bit += 1
                    enter.append((bit, accepts))
            last.append(divmod(bit, 64))
            at = bit + 1
        words = max(1, -(-at // 64))
        step, stay = (np.zeros((256, words), np.uint64) for _ in range(2))
        for table, entries in ((step, enter), (stay, loop)):
            for bit, accepts in entries:
                rows = [c for c in range(256) if accepts >> c & 1]
                table[rows, bit // 64] |= np.uint64(1 << bit % 64)
        first = np.zeros(words, np.uint64)
        for bit in start:
            first[bit // 64] |= np.uint64(1 << bit % 64)
        return cls(step, stay, first, last)

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """A boolean row per URL: which patterns accept it."""
        size = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        begin = np.cumsum(size) - size
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -j, side="left"))  # those longer than j
            chars = data[begin[:k] + j]
            now = state[:k]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:k] = (moved & self.step[chars]) | (now & self.stay[chars])
        out = np.empty((len(urls), len(self.last)), bool)
        for p, (word, bit) in enumerate(self.last):
            out[order, p] = (state[:, word] >> np.uint64(bit) & one).astype(bool)
        return out


class UrlFilter:
    """Judges URLs by host and path-prefix rules, then by the method's own globs."""

    def __init__(self, rules=RULES, globs=GLOBS, default: str = "allow"):
        longest = lambda xs: [x for _, x in sorted(enumerate(xs), key=lambda x: (-len(x[1][1]), x[0]))]
        self.rules, self.globs, self.default = longest(rules), longest(globs), default
        cut = lambda rule: (rule.partition("/")[0], "".join(rule.partition("/")[1:]))
        self.automaton = WildcardAutomaton.build(
            [_tokens(*cut(r), True) for _, r in self.rules] + [_tokens(*cut(g), False) for _, g in self.globs]
        )

    def judge(self, urls: Sequence[str | None]) -> pd.DataFrame:
        parts = [split_url(u) for u in urls]
        hit = self.automaton.match([b"." + h.encode() + b"\xff" + p.encode() for h, p in parts])
        n = len(self.rules)

        def first(found: np.ndarray) -> np.ndarray:
            if not found.shape[1]:
                return np.full(len(found), -1)
            return np.where(found.any(axis=1), found.argmax(axis=1), -1)

        by_rule, by_glob = first(hit[:, :n]), first(hit[:, n:])
        return pd.DataFrame(
            {
                "host": [h for h, _ in parts],
                "path": [p for _, p in parts],
                "rule": [self.rules[r][1] if r >= 0 else None for r in by_rule],
                "glob": [self.globs[g][1] if g >= 0 else None for g in by_glob],
                "verdict": [self.rules[r][0] if r >= 0 else self.globs[g][0] if g >= 0 else self.default for r, g in zip(by_rule, by_glob)],
            },
            columns=["host", "path", "rule", "glob", "verdict"],
        )

    def apply(self, df: DataFrame, url: str = "url") -> DataFrame:
        """``df`` with host, path, rule, glob and verdict.  One narrow pass, no shuffle."""
        judge = self.judge

        @F.pandas_udf("host string, path string, rule string, glob string, verdict string")
        def verdicts(urls: pd.Series) -> pd.DataFrame:
            return judge([None if u is None or u != u else u for u in urls])

        found = "_url_filter"
        while found in df.columns:
            found += "_"
        names = ("host", "path", "rule", "glob", "verdict")
        df = df.withColumn(found, verdicts(named(url).cast("string")))
        return df.withColumns({c: F.col(f"{found}.{c}") for c in names}).drop(found)


def _regex(glob: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


def sql(rules=RULES, globs=GLOBS, default: str = "allow") -> str:
    """The same verdicts in DuckDB's SQL, over the view ``pages``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    own = UrlFilter(rules, globs, default)
    cases, verdicts, own_globs = [], [], []
    for verdict, rule in own.rules:
        host, _, path = rule.partition("/")
        fits = f"(ends_with('.' || host, {quote('.' + host)}) AND starts_with(path, {quote('/' + path)}))"
        cases.append(f"WHEN {fits} THEN {quote(rule)}")
        verdicts.append(f"WHEN {fits} THEN {quote(verdict)}")
    for verdict, glob in own.globs:
        host, sep, path = glob.partition("/")
        fits = f"(regexp_full_match('.' || host, {quote('(?s).*[.]' + _regex(host))}) AND regexp_full_match(path, {quote('(?s)' + _regex(sep + path))}))"
        own_globs.append(f"WHEN {fits} THEN {quote(glob)}")
        verdicts.append(f"WHEN {fits} THEN {quote(verdict)}")
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {' '.join(cases)} END AS rule, CASE {' '.join(own_globs)} END AS glob,
       CASE {' '.join(verdicts)} ELSE {quote(default)} END AS verdict FROM p"""
