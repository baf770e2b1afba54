"""Licence scans: exact phrases, and a fuzzy search for short notices.

A notice of n characters may differ by ``n // 12`` edits.  It is cut into one piece more
than that, so one piece at least stands unchanged in every match (pigeonhole).  The
pieces are looked for exactly; around each one the ``regex`` module's bounded-error
matching verifies the edits and gives the span.  Of matches that overlap, the one with
fewer edits for its length stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The exact phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Short notices, as the words of a text are written here (lower case, one space between).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "creative commons zero 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
MATCH = "label string, first_word long, last_word long, edits int, similarity double"
RESULT = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>"
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PHRASES = tuple((f" {p} ".encode(), label) for p, label in PHRASES)


def words_joined(text: str | None) -> tuple[bytes, int]:
    """Lower-cased words with one space before, between and after them, and how many they are."""
    found = text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []
    return b" " + b" ".join(found) + b" " if found else b" ", len(found)


def edits_allowed(notice: str) -> int:
    return len(notice) // 12


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in ``edits + 1`` pieces, each with its place."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _prepared(notices: tuple[tuple[str, str], ...]):
    by_seed: dict[bytes, list[tuple[int, int]]] = {}
    patterns = []
    for i, (_, notice) in enumerate(notices):
        k = edits_allowed(notice)
        patterns.append((k, regex.compile(rf"(?be)(?:{regex.escape(notice, special_only=True)}){{e<={k}}}")))
        for at, seed in seeds(notice, k):
            by_seed.setdefault(seed.encode(), []).append((i, at))
    return by_seed, patterns


def matches(pattern: regex.Pattern, text: str, start: int, end: int) -> list[regex.Match]:
    """The best match between two places, and then those on either side of it."""
    out, open_ = [], [(start, end)]
    while open_:
        a, b = open_.pop()
        m = pattern.search(text, a, b) if a < b else None
        if m and m.end() > m.start():
            out.append(m)
            open_ += [(a, m.start()), (m.end(), b)]
    return out


def fuzzy(joined: bytes, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[str, int, int, int, float]]:
    """Matches as (label, first word, last word, edits, similarity), in order of place."""
    by_seed, patterns = _prepared(notices)
    windows: dict[int, list[list[int]]] = {}
    text = None
    for seed, uses in by_seed.items():
        if seed not in joined:
            continue
        text = joined.decode("utf-8", "surrogatepass") if text is None else text
        piece, at = seed.decode(), -1
        while (at := text.find(piece, at + 1)) >= 0:
            for i, offset in uses:
                k = patterns[i][0]
                windows.setdefault(i, []).append([max(0, at - offset - k), at - offset + len(notices[i][1]) + k])
    found = []
    for i, spans in windows.items():
        label, notice = notices[i]
        spans.sort()
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            for m in matches(patterns[i][1], text, a, min(b, len(text))):
                edits = sum(m.fuzzy_counts)
                found.append((edits / len(notice), -(m.end() - m.start()), m.start(), m.end(), label, edits))
    kept: list[tuple] = []
    for hit in sorted(found):
        if all(hit[3] <= other[2] or other[3] <= hit[2] for other in kept):
            kept.append(hit)
    out = []
    for share, _, start, end, label, edits in sorted(kept, key=lambda h: (h[2], h[4])):
        inner = text[start:end]
        first = text.count(" ", 0, start + len(inner) - len(inner.lstrip(" "))) - 1
        last = text.count(" ", 0, end - (len(inner) - len(inner.rstrip(" ")))) - 1
        out.append((label, max(first, 0), max(last, 0), edits, 1.0 - share))
    return out


def scan_text(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES) -> tuple:
    joined, n = words_joined(text)
    places, labels = [], set()
    for phrase, label in _PHRASES:
        at = -1
        while (at := joined.find(phrase, at + 1)) >= 0:
            places.append(at)
            labels.add(label)
    starts = [joined.count(b" ", 0, at) for at in (min(places), max(places))] if places else [None, None]
    return n, len(places), *starts, sorted(labels), fuzzy(joined, notices)


def scan(docs: DataFrame, text_col: str = "text", *, notices: tuple[tuple[str, str], ...] = NOTICES, out: str = "licence") -> DataFrame:
    """``docs`` with a column of n_words, exact places and labels, and fuzzy matches; no shuffle.

    A null or empty text has no words, no labels and null places; a text of any length is
    searched whole.  A column of ``docs`` with the output's name is replaced; repeated rows
    stay; an empty table gives no rows.
    """

    @F.pandas_udf(RESULT)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["label", "first_word", "last_word", "edits", "similarity"]
        for part in texts:
            rows = [scan_text(t, notices) for t in part]
            frame = pd.DataFrame([(*r[:5], [dict(zip(names, m)) for m in r[5]]) for r in rows], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "matches"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], scanned(F.col(text_col)).alias(out))
    return rest
