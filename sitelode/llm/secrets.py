"""Secret scans inside one row: fixed patterns and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns: kind, pattern, group whose length counts, least length.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE_KINDS = (
    ("assign", ASSIGN, 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ENTROPY_KIND = "entropy"
#: Candidate strings of the entropy scan: maximal runs of this class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Runs inside a candidate by character class: name, class, least bits a character.
CLASSES = (
    ("hex", "[0-9A-Fa-f]+", 3.0),
    ("alnum", "[0-9A-Za-z]+", 3.75),
    ("base64", "[0-9A-Za-z+/_=-]+", 4.0),
)
WINDOW = 20
#: Candidates that fit one of these are never reported by the entropy scan.
ALLOWED = (
    r"^[A-Za-z]+([+/_=-]+[A-Za-z]+)*[+/_=-]*$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|abcdefgh|01234567|12345678",
)
#: Parts of a bit; entropy is compared in whole numbers so that no rounding decides.
SCALE = 1 << 20


def _found(text: str, pattern: str) -> str:
    """Matches of a pattern as array<struct<start,end,word>>: code points, end exclusive.

    Java's split and find walk over the same matches, so the lengths of pieces
    and matches add up to the offsets.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""aggregate(
        arrays_zip(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0)),
        named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,end:int,word:string>>)),
        (s, x) -> IF(x['1'] IS NULL, s, named_struct(
            'at', s.at + length(x['0']) + length(x['1']),
            'out', concat(s.out, array(named_struct('start', s.at + length(x['0']), 'end', s.at + length(x['0']) + length(x['1']), 'word', x['1']))))),
        s -> s.out)"""


def _weights(window: int) -> list[int]:
    """c * log2(c) in parts of a bit for c = 0..window."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def least_sum(bits: float, window: int) -> int:
    """The largest sum of c * log2(c) over the counts of a window with at least `bits` of entropy."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def _lowest_sum(run: str, window: int) -> str:
    """Lowest sum of c*log2(c) over all windows of a run of ASCII characters.

    The state holds the counts of the 128 characters as a text with one character
    a count, and the running sum. A step raises the count of the entering
    character, lowers that of the leaving one and corrects the sum by the two
    differences, so no window is counted anew.
    """
    weight = "array(" + ",".join(f"{w}L" for w in _weights(window)) + ")"
    code, change = "ascii(s.c[abs(k) - 1])", "IF(k > 0, 1, -1)"
    count = f"(ascii(substring(s.n, {code} + 1, 1)) - 32)"
    total = f"(s.sum + {weight}[{count} + {change}] - {weight}[{count}])"
    return f"""aggregate(
        flatten(transform(sequence(1, length({run})), i -> IF(i > {window}, array({window} - i, i), array(i)))),
        named_struct('c', split({run}, ''), 'n', repeat(' ', 128), 'sum', 0L, 'low', {1 << 60}L),
        (s, k) -> named_struct(
            'c', s.c,
            'n', overlay(s.n PLACING chr({count} + {change} + 32) FROM {code} + 1 FOR 1),
            'sum', {total},
            'low', IF(k >= {window}, least(s.low, {total}), s.low)),
        s -> s.low)"""


def _high_entropy(word: str, window: int) -> str:
    """Whether a candidate has a window of one character class above that class's entropy."""
    tests = [
        f"""exists(filter(regexp_extract_all({word}, '{runs}', 0), r -> length(r) >= {window}),
            r -> {_lowest_sum('r', window)} <= {least_sum(bits, window)}L)"""
        for _, runs, bits in CLASSES
    ]
    return "(" + " OR ".join(tests) + ")"


def find_secrets(
    df: DataFrame,
    text: str = "text",
    *,
    entropy: bool = True,
    window: int = WINDOW,
    allowed: Sequence[str] = ALLOWED,
    out: str = "spans",
) -> DataFrame:
    """Add `out`: array<struct<start,kind_no,kind,end>> of all secrets of a text, by start.

    Base kinds are the fixed patterns, leftmost and non-overlapping per kind;
    matches too short are dropped after matching. Kind `entropy` adds every
    candidate string that no allow-list pattern fits and that has a window of
    `window` characters of one class with at least that class's Shannon entropy.
    Offsets count code points, ends are exclusive. A null or empty text has no
    spans. Rows, repeated ones too, and all other columns are kept; a former column `out` is replaced.

    Everything happens inside the row: no shuffle, and a text without any match is only read
    once per pattern.
    """
    whole = "__whole_text"
    df = df.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    parts = []
    empty = "CAST(array() AS array<struct<start:int,kind_no:int,kind:string,end:int>>)"
    for number, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        found = _found(whole, pattern)
        long_enough = f"length(regexp_extract(x.word, '{quoted}', {group})) >= {least}" if group else f"length(x.word) >= {least}"
        parts.append(
            f"""IF({whole} RLIKE '{quoted}', transform(filter({found}, x -> {long_enough}),
                x -> named_struct('start', x.start, 'kind_no', {number}, 'kind', '{kind}', 'end', x.end)), {empty})"""
        )
    if entropy:
        harmless = "".join(
            " AND NOT x.word RLIKE '{}'".format(a.replace("\\", "\\\\").replace("'", "\\'")) for a in allowed
        )
        parts.append(
            f"""IF({whole} RLIKE '{CANDIDATE}', transform(
                filter({_found(whole, CANDIDATE)}, x -> true{harmless} AND {_high_entropy('x.word', window)}),
                x -> named_struct('start', x.start, 'kind_no', {len(BASE_KINDS)}, 'kind', '{ENTROPY_KIND}', 'end', x.end)), {empty})"""
        )
    return df.withColumn(out, F.array_sort(F.expr(f"concat({', '.join(parts)})"))).drop(whole)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redacted(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by `mark`; overlapping spans give one mark. A text without spans stays as it is."""
    return F.expr(
        f"""IF(size({spans}) = 0, {text}, aggregate({spans}, named_struct('at', 0, 'out', ''),
            (s, x) -> IF(x.start < s.at, named_struct('at', greatest(s.at, x.end), 'out', s.out), named_struct(
                'at', x.end, 'out', concat(s.out, substring({text}, s.at + 1, x.start - s.at), '{mark}'))),
            s -> concat(s.out, substring({text}, s.at + 1))))"""
    )
