"""How a reviewer of the stand-in labels a candidate: by published formats and by what
stands beside it.  A shape that neither speaks for has no label."""

from __future__ import annotations

import re

#: characters kept on each side of a labelled finding
CONTEXT = 120

#: fixed values: published formats of keys and tokens
FORMATS = tuple(map(re.compile, (
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36,}", r"github_pat_[0-9A-Za-z_]{60,}",
    r"xox[abeoprs]-[0-9A-Za-z\-]{10,}", r"(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,}", r"AIza[0-9A-Za-z_\-]{35}",
    r"npm_[0-9A-Za-z]{36}", r"hf_[0-9A-Za-z]{30,}", r"eyJ[0-9A-Za-z_\-]{17,}", r"sk-[0-9A-Za-z_\-]{32,}")))
#: a digest, or a key that looks like one
DIGEST = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
#: the two parts of a JSON web token before its third
SIGNED = re.compile(r"eyJ[0-9A-Za-z_\-]{8,}\.eyJ[0-9A-Za-z_\-]{8,}\.$")
NAME = (r"(?:passw(?:or)?d|pass[_\-]?phrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth(?:orization)?"
        r"|credentials?|bearer)")
#: assigned to a credential's name, after Bearer or Basic, or after a URL's user
ASSIGNED = re.compile(rf"(?i){NAME}[0-9a-z_\-]{{0,20}}[\"']?\]?\s{{0,2}}(?::=|={{1,2}}>?|:)\s{{0,2}}[\"'`]?$|\b(?:bearer|basic)\s{{1,2}}$|://[^\s/:@]{{0,64}}:$")
#: the name of a credential a little before
NAMED = re.compile(rf"(?i){NAME}\W{{0,3}}(?:\w+\W{{1,3}}){{0,2}}$")
#: made-up values, and what code stands for a value that is elsewhere
MADE_UP = re.compile(r"(?i)example|sample|dummy|fake|placeholder|change_?me|your[_\-]|redacted|x{4}|\*{3}|0123456789|1234567890|abcdefgh")
ELSEWHERE = re.compile(r"[$%<{].*|(?:[A-Za-z_]+\.)+[A-Za-z_]+|(?i:required|optional|undefined|password|varchar|getpass)")
#: words, one or joined; numbers; rulers
WORDS = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|(?:[A-Za-z]?[a-z]+|[A-Z]+|\d{1,4})(?:[_+/\-]+(?:[A-Za-z]?[a-z]+|[A-Z]+|\d{1,4}))+[_+/\-]*")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
NO_VALUE = re.compile(r"[0-9_+/=\-]+")
#: parts of a path where values are made up
MADE_UP_PATHS = ("test", "example", "sample", "mock", "fixture")


def label(text: str, start: int, end: int, path: str | None) -> int | None:
    """1: a secret, 0: none, null: the reviewer can't tell."""
    value, before = text[start:end], text[max(0, start - CONTEXT):start]
    if MADE_UP.search(value) or len(set(value)) <= 3:
        return 0
    assigned = bool(ASSIGNED.search(before))
    if any(f.fullmatch(value) for f in FORMATS) or SIGNED.search(before):
        return None if any(p in (path or "").lower() for p in MADE_UP_PATHS) else 1
    if assigned and (ELSEWHERE.fullmatch(value) or text[end:end + 1] == "("):
        return 0
    if assigned:
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        odd = any(not c.isalnum() for c in value.strip("_-./:")) and not WORDS.fullmatch(value)
        if any(p in (path or "").lower() for p in MADE_UP_PATHS) or not (mixed or odd):
            return None
        return 1
    if NAMED.search(before):
        return None
    if DIGEST.fullmatch(value) or UUID.fullmatch(value) or WORDS.fullmatch(value) or NO_VALUE.fullmatch(value):
        return 0
    return None
