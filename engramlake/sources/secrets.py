"""Credentials in texts: which text is refused, and what is left of it when they are blanked out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MASK = "***"

# Endings of field names whose value is a credential, and beginnings of providers' keys.
FIELDS = {
    "password": "password field", "passwd": "password field", "pwd": "password field", "token": "token field",
    "secret": "secret field", "api_key": "api key field", "apikey": "api key field",
}
PREFIXES = {
    "sk-": "provider api key", "ghp_": "github token", "gho_": "github token", "github_pat_": "github token",
    "xoxb-": "slack token", "xoxp-": "slack token", "AKIA": "aws access key id",
}
SHORTEST, SHORTEST_LETTERS, BEYOND_PREFIX = 6, 16, 8

_RUN = re.compile(r"\S+")
_URL = re.compile(r"^(?P<keep>[^@]*?://[^@:]*:)(?P<value>[^@]*)(?P<rest>@.*)$", re.S)
_FIELD = re.compile(r"^(?P<key>[^=:]+)[=:](?P<value>.*)$", re.S)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_KEY_EDGE = re.compile(r"^\W+|\W+$")
_JWT = re.compile(r"^eyJ[^.]*\.[^.]*\.[^.]*$", re.S)


def opaque(value: str) -> bool:
    """Long enough for a credential, with a digit or very long."""
    bare = _EDGE.sub("", value)
    return len(bare) >= SHORTEST and (any(c in "0123456789" for c in bare) or len(bare) >= SHORTEST_LETTERS)


def field_kind(key: str) -> str | None:
    low = _KEY_EDGE.sub("", key).lower()
    return next((kind for name, kind in FIELDS.items() if low.endswith(name)), None)


def judge_run(run: str, awaited: str | None) -> tuple[str, str | None, str | None]:
    """(what stands instead, kind if the run is to be refused, kind that the next run's value would have)."""
    if awaited:
        return MASK, awaited if opaque(run) else None, None
    if m := _URL.match(run):
        return m["keep"] + MASK + m["rest"], "credentials in a url", None
    if (m := _FIELD.match(run)) and (kind := field_kind(m["key"])):
        head = run[: len(m["key"]) + 1]
        return (head + MASK, kind if opaque(m["value"]) else None, None) if m["value"] else (head, None, kind)
    bare = re.sub(r"^[\W_]+", "", run)
    found = sorted((bare.find(p), p) for p in PREFIXES if p in bare and len(bare) - bare.find(p) > len(p) + BEYOND_PREFIX)
    lead = run[: len(run) - len(bare)]
    if found:
        return lead + bare[: found[0][0]] + MASK, PREFIXES[found[0][1]], None
    if _JWT.match(bare):
        return lead + MASK, "jwt bearer token", None
    return run, None, None


def scan(text: str | None) -> tuple[str | None, str | None, int | None]:
    """(text with credentials blanked out, kind of the first refused one or None, its character offset)."""
    if text is None:
        return None, None, None
    out, at, awaited, first = [], 0, None, None
    for m in _RUN.finditer(text):
        put, kind, awaited = judge_run(m[0], awaited)
        out += [text[at : m.start()], put]
        at = m.end()
        if kind and first is None:
            first = (kind, m.start())
    out.append(text[at:])
    return "".join(out), *(first or (None, None))


def scan_secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted, kind, offset) for each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [scan(t) for t in p[text]]
            yield pd.DataFrame({
                key: p[key], "redacted": [f[0] for f in found], "kind": [f[1] for f in found],
                "offset": pd.array([f[2] for f in found], "Int32")})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, redacted string, kind string, offset int")
