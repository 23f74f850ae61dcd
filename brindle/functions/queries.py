"""Parsing of raw search strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = '+-"*()~'


def _stripped(s: str, keep_hyphen: bool = False) -> str:
    return " ".join("".join("" if c == '"' else c if c not in RESERVED or (c == "-" and keep_hyphen) else " " for c in s).split())


def parse(raw: str | None) -> list[tuple[str, str]]:
    """(kind, term): phrase for terms with - or ., prefix for up to three bytes, else term; if nothing is left, the stripped or the raw string."""
    terms, buf, quoted = [], "", False
    for c in raw or "":
        quoted ^= c == '"'
        if c in " \t\n" and not quoted:
            terms, buf = [*terms, buf], ""
        else:
            buf += c
    out = []
    for t in filter(None, [*terms, buf]):
        phrase = "-" in t or "." in t
        if cleaned := _stripped(t, phrase):
            out.append(("phrase" if phrase else "prefix" if len(cleaned.encode()) <= 3 else "term", cleaned))
    return out or [("term", x) for x in (_stripped(raw or "") or (raw or ""),) if x]


def parse_query(raw: Column) -> Column:
    @F.pandas_udf("array<struct<kind:string,term:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"kind": k, "term": t} for k, t in parse(x)])

    return run(raw)
