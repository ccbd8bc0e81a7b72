"""Secret scans: fixed patterns, and sliding-window entropy by character class."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import id_and_text, table

# The base patterns, with their kinds in the order that breaks ties.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_upper", "entropy_base64", "entropy_base36")
#: Where an assignment can begin: every keyword has one of these, in either case.
KEYWORD = re.compile(r"passw|secret|token|api_?key")
ASSIGN_VALUE_CHARS = 12

#: Character classes: candidate pattern, window in characters, least bits a character, needed kinds of character.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0, 2),
    "entropy_upper": (re.compile(r"[A-Z0-9]{20,}"), 20, 3.4, 2),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_-]{24,}"), 24, 3.9, 3),
    "entropy_base36": (re.compile(r"[a-z0-9]{24,}"), 24, 3.6, 2),
}
#: Stretches up to this length aren't secret if the allow-list names a part of them. In longer ones, which hold
#: some of these strings by chance, only the windows that overlap such a part are left out.
ALLOWED_WHOLE = 128
#: Candidates that look random but aren't secret: version-4 style identifiers, examples, alphabets, placeholders.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?i)example|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxx"),
    re.compile(r"(?i)abcdefghij|0123456789abcdef"),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost non-overlapping for each kind, failing matches dropped.

    A failing assignment still uses up its characters, so it is found first and dropped then.
    The other two patterns are maximal runs; what is too short can be left out of the search.
    """
    found = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if KEYWORD.search(text.lower()) is not None:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE_CHARS]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def entropy_windows(value: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged ranges of ``value`` covered by windows of ``width`` characters with ``least`` bits a character or more.

    The counts change by one character in and one out at each step. With S the sum of
    c * log2(c) over the counts, a window's entropy is log2(width) - S / width.
    """
    if len(value) < width:
        return []
    cost = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    s = 0.0
    for c in value[:width]:
        n = counts.get(c, 0)
        counts[c] = n + 1
        s += cost[n + 1] - cost[n]
    most = (math.log2(width) - least) * width + 1e-9
    out: list[tuple[int, int]] = []
    for at in range(len(value) - width + 1):
        if at:
            gone, come = value[at - 1], value[at + width - 1]
            n = counts[gone]
            counts[gone] = n - 1
            s += cost[n - 1] - cost[n]
            n = counts.get(come, 0)
            counts[come] = n + 1
            s += cost[n + 1] - cost[n]
        if s <= most:
            if out and at <= out[-1][1]:
                out[-1] = (out[-1][0], at + width)
            else:
                out.append((at, at + width))
    return out


class Cover:
    """Tells whether a range lies within one of the given spans."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        ordered = sorted(spans)
        self.starts = [x[0] for x in ordered]
        self.ends = list(accumulate((x[1] for x in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= end


def not_allowed(value: str, stretches: list[tuple[int, int]], width: int, least: float) -> list[tuple[int, int]]:
    """``stretches`` of the candidate ``value`` without what the allow-list names."""
    named = sorted((m.start(), m.end()) for x in ALLOWED for m in x.finditer(value)) if stretches else []
    if not named:
        return stretches
    ends = list(accumulate((b for _, b in named), max))
    out = []
    for a, b in stretches:
        at = bisect_right(ends, a)  # the first that ends inside the stretch or behind it
        if at == len(named) or named[at][0] >= b:
            out.append((a, b))
        elif b - a > ALLOWED_WHOLE:
            while at < len(named) and named[at][0] < b:
                out += [(a + x, a + y) for x, y in entropy_windows(value[a : named[at][0]], width, least)]
                a = max(a, named[at][1])
                at += 1
            out += [(a + x, a + y) for x, y in entropy_windows(value[a:b], width, least)]
    return out


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of random-looking stretches of candidate strings, without those the allow-list names.

    A stretch must hold as many kinds of character (lower, upper, digit) as its class asks
    for; a stretch inside one of a class named earlier is left out.
    """
    out: list[tuple[int, int, str]] = []
    for kind, (pattern, width, least, kinds) in CLASSES.items():
        earlier = Cover(out)
        for m in pattern.finditer(text):
            value = m[0]
            for a, b in not_allowed(value, entropy_windows(value, width, least), width, least):
                part = value[a:b]
                has = any(c.islower() for c in part) + any(c.isupper() for c in part) + any(c.isdigit() for c in part)
                start, end = m.start() + a, m.start() + b
                if has >= kinds and not earlier.holds(start, end):
                    out.append((start, end, kind))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans (entropy stretches inside a base span of the same text are left out)."""
    base = base_spans(text)
    cover = Cover(base)
    more = [x for x in entropy_spans(text) if not cover.holds(x[0], x[1])]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its secrets: array of (kind, start, end) in code points, end exclusive; base and all counts.

    One row for each row of ``docs``. Null and empty texts have none; repeated rows and null
    ids stay; columns other than doc_id and text are ignored; an empty table gives no rows.
    Spans come by start, then by kind in the order of ``KINDS``. Texts are scanned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(count(k) for k in KINDS[:3]),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(every) for _, every in found], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[SECRET]"


def mask(text: str) -> str:
    """The text with each group of overlapping spans replaced by a mark."""
    out, at = [], 0
    for start, end, _ in scan(text)[1]:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns and rows, secrets in ``text`` replaced by a mark; null texts stay null.

    A column n_chars, if there, becomes the new text's length where the text has changed.
    """
    names, schema = docs.columns, docs.schema
    text, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = [t and mask(t) for t in old]
            columns = list(batch.columns)
            columns[text] = pa.array(new, columns[text].type)
            if size >= 0:
                kept = columns[size].to_pylist()
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(kept, old, new, strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
