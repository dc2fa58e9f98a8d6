"""Secret scans with a trigram inverted index.

Every rule is a regular expression.  Its Boolean trigram query is derived from Python's
own parse of the expression: literals and small classes multiply out to exact strings,
whose trigrams are joined by AND; alternatives are joined by OR; what can be anything
asks for nothing.  The trigrams are lower-cased on both sides, so rules that ignore case
need no query of their own.

The index is built per segment (an Arrow batch of documents, bounded by Spark in rows
and bytes): postings of the trigrams that occur in any query.  A rule's query intersects
and unites postings; only the candidates are verified by the expression on the whole text.
Rules without mandatory trigrams scan every document.  Segments are independent, so there
is no shuffle, and a lost task is simply run again.

Defined cases: a null text is an empty one and has no span; repeated rows are scanned
each; an empty table gives an empty result; positions are code points, ends exclusive;
spans are ordered by start, then by the order of the rules, then by end; spans of
different kinds may overlap, spans of one kind never do.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwise.llm.common import tidy

SPANS = "array<struct<kind:string,start:int,end:int>>"

# Strings multiplied out at most before the trigrams are taken.
_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; of these, matches whose ``group`` has fewer than ``least``
    characters are dropped.  Letters match in either case if ``any_case``."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# A PEM key: all up to its END line if no other BEGIN or END line comes first; else header
# fields and runs of base64, which are long or alone on their lines.
_PEM = (
    r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z]+ )?PRIVATE KEY-----"
    r"|(?:(?:\\[nrt]|[\s\"'>#*])*+(?:Proc-Type|DEK-Info):[^\n]*+)*+"
    r"(?:(?:\\[nrt]|[\s\"'>#*])*+(?:[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]{1,15}+={1,2})"
    r"|\s*\n[\x20\t]*[A-Za-z0-9+/]++={0,2}[\x20\t\r]*(?=\n|\Z))*+)"
)

# The base rules, then well-known public token formats.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # a run of 24 or more, which is what remains of all runs when shorter ones are dropped
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE_RULES + (
    Rule("private_key", _PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z]{3,8}://[A-Za-z0-9._%-]++:[A-Za-z0-9._~!$&*+%-]{3,}+@[A-Za-z0-9.-]{3,}"),
)

# --- trigram queries: True, a trigram, ("and", ...) or ("or", ...) ---------------------------


def _join(op: str, parts: list) -> object:
    """AND or OR of queries; True is the query that asks for nothing."""
    if op == "or" and (True in parts or not parts):
        return True
    parts = sorted({p for p in parts if p is not True}, key=repr)
    return True if not parts else parts[0] if len(parts) == 1 else (op, *parts)


def _of_strings(exact: set[str]) -> object:
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in exact])


def _charset(items: list) -> set[str] | None:
    """The lower-cased characters of a class, if they are few."""
    out: set[str] = set()
    for op, value in items:
        if op is rc.LITERAL:
            out.add(chr(value).lower())
        elif op is rc.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(nodes) -> tuple[set[str] | None, object]:
    """(all strings matched, if few; else None) and the query that every match meets."""
    query, run = [], {""}
    exact = True
    for op, value in nodes:
        strings, asks = _one(op, value)
        if strings is not None and len(run) * len(strings) <= _EXACT:
            run = {a + b for a, b in itertools.product(run, strings)}
            continue
        exact = False
        query += [_of_strings(run), asks if strings is None else True]
        run = strings or {""}
    return (run, _of_strings(run)) if exact else (None, _join("and", [*query, _of_strings(run)]))


def _one(op, value) -> tuple[set[str] | None, object]:
    if op is rc.LITERAL:
        return {chr(value).lower()}, True
    if op is rc.IN:
        return _charset(value), True
    if op is rc.AT:
        return {""}, True
    if op is rc.SUBPATTERN:
        return _analyse(value[-1])
    if op is rc.BRANCH:
        parts = [_analyse(x) for x in value[1]]
        strings = set().union(*(s or () for s, _ in parts))
        if all(s is not None for s, _ in parts) and len(strings) <= _EXACT:
            return strings, True
        return None, _join("or", [q for _, q in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        least, most, body = value
        strings, asks = _analyse(body)
        if strings is not None and most <= 3 and sum(len(strings) ** n for n in range(least, most + 1)) <= _EXACT:
            return {"".join(p) for n in range(least, most + 1) for p in itertools.product(strings, repeat=n)}, True
        return None, asks if least else True
    return None, True


def trigram_query(rule: Rule) -> object:
    """The Boolean trigram query of a rule; True if no trigram is mandatory."""
    return _analyse(rp.parse(rule.pattern, re.ASCII))[1]


def _trigrams(query: object) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(_trigrams, query[1:]))


def _candidates(query: object, postings: dict[str, set[int]], every: range):
    """Document positions that meet a query, by intersecting and uniting postings."""
    if query is True:
        return every
    if isinstance(query, str):
        return postings[query]
    found = [_candidates(q, postings, every) for q in query[1:]]
    return set.intersection(*sorted(found, key=len)) if query[0] == "and" else set.union(*found)


def _index(texts: list[str], trigrams: list[str]) -> dict[str, set[int]]:
    """Postings of one segment for the trigrams that queries ask for."""
    postings: dict[str, set[int]] = {t: set() for t in trigrams}
    for i, text in enumerate(texts):
        folded = text.lower()
        for t in trigrams:
            if t in folded:
                postings[t].add(i)
    return postings


@functools.lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]) -> tuple[list, list[str]]:
    plans = [(rule, rule.regex(), trigram_query(rule)) for rule in rules]
    return plans, sorted(set().union(*(_trigrams(q) for _, _, q in plans)))


def scan_segment(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """Spans ``(kind, start, end)`` of each text of a segment."""
    plans, trigrams = _compiled(rules)
    postings = _index(texts, trigrams)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for order, (rule, regex, query) in enumerate(plans):
        for i in _candidates(query, postings, range(len(texts))):
            found[i] += [(m.start(), order, m.end()) for m in regex.finditer(texts[i])
                         if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [[(rules[order].kind, start, end) for start, order, end in sorted(spans)] for spans in found]


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of the secrets of a text column."""

    @F.pandas_udf(SPANS)
    @tidy
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            spans = scan_segment([t or "" for t in batch], rules)
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in of] for of in spans], dtype=object)

    return scan(text)


def redacted(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> Column:
    """The text with every secret (overlapping spans together) replaced by ``mark``; null stays null."""

    @F.pandas_udf("string")
    @tidy
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = list(batch)
            spans = scan_segment([t or "" for t in texts], rules)
            yield pd.Series([_hide(t, of, mark) if of else t for t, of in zip(texts, spans)], dtype=object)

    return hide(text)


def _hide(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
