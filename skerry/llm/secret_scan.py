"""Secret scans: fixed patterns plus sliding-window Shannon entropy per character class.

Candidates are runs of 20 or more characters of keys and digests. For each character class a window slides over
the run's stretches of that class; counts are updated by one character in and one out, and the window's entropy
follows from the running sum of c*log2(c). Windows above the class's threshold that hold the characters the class
asks for are merged into one span. An allow-list suppresses identifiers and placeholders: some by the form of the
whole run; words and UUIDs that stand between joiners are cut out, so that what is joined to them is still scanned;
a span that meets a placeholder without a joiner is dropped. Runs of plain words and numbers are no URL-safe keys.

Defined results: a null text counts as empty and has no spans; spans are code points, end exclusive; repeated rows
get equal results; null ids stay null; other columns are not read by `scanned` and pass through `redacted`.
Rows are scanned one by one, so memory follows the longest text, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")
# Fixed patterns; ASCII, so that letters in either case are A-Z and a-z only.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

WIDTH = 20
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{WIDTH},}}={{0,2}}")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class CharClass:
    """A stretch of `chars`, whose windows need this entropy (bits) and so many characters of each group."""

    name: str
    chars: str
    bits: float
    needs: tuple[tuple[str, int], ...]


_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("hex", _NUM + "abcdef", 3.0, ((_NUM, 2), ("abcdef", 2))),
    CharClass("HEX", _NUM + "ABCDEF", 3.0, ((_NUM, 2), ("ABCDEF", 2))),
    CharClass("lower", _NUM + _LOW, 3.6, ((_NUM, 3), (_LOW, 3))),
    CharClass("upper", _NUM + _UP, 3.6, ((_NUM, 2), (_UP, 3))),
    CharClass("base64", _NUM + _LOW + _UP + "+/", 3.8, ((_NUM, 1), (_LOW, 2), (_UP, 2))),
    CharClass("base64url", _NUM + _LOW + _UP + "-_", 3.8, ((_NUM, 1), (_LOW, 2), (_UP, 2))),
)
_STRETCH = {c.name: re.compile(f"[{re.escape(c.chars)}]{{{WIDTH},}}") for c in CLASSES}

# Fixed patterns of harmless strings, matched against the whole candidate.
ALLOWED = tuple(
    re.compile(x)
    for x in (
        r"[0-9/_+-]*",
        r"[A-Za-z]+(?:[/_-][A-Za-z]+)+[/_-]?[0-9]{0,4}",
    )
)
# Harmless strings within a candidate.
_WORD = re.compile(r"(?i)example|placeholder|changeme|your[_-]?key|xxxx|abcdefghij|0123456789|1234567890")
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
_PART = re.compile(r"[A-Za-z0-9]+")
_JOINER = re.compile(r"[/_+=-]+")
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]{2,}+)++[0-9]*|[A-Z]+[0-9]*|[A-Za-z]?[0-9]*")


def plain(run: str) -> bool:
    """Whether all parts between joiners are words, in usual case, or numbers."""
    return all(_PLAIN.fullmatch(part) for part in _JOINER.split(run))


def harmless(run: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches of words and UUIDs between joiners, by start, and placeholders that stand within other characters."""
    apart, within = {m.span() for m in _UUID.finditer(run)}, []
    parts = [m.span() for m in _PART.finditer(run)] if _WORD.search(run) else []
    starts, whole, usual = [a for a, _ in parts], None, False
    for m in _WORD.finditer(run):
        a, b = m.span()  # a word begins and ends with a letter or a digit, so within a part
        around = starts[bisect_right(starts, a) - 1], parts[bisect_right(starts, b - 1) - 1][1]
        if around != whole:
            whole, usual = around, plain(run[around[0] : around[1]])
        if usual:
            apart.add(around)
        else:
            within.append((a, b))
    return sorted(apart), within


def windows_above(text: str, cls: CharClass, width: int = WIDTH) -> Iterator[tuple[int, int]]:
    """Start and end of the merged windows of one stretch that pass; one character enters and one leaves at a time."""
    plogp = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    groups = [frozenset(g) for g, _ in cls.needs]
    have = [0] * len(groups)
    total = 0.0
    first = last = -1  # of the merged windows so far
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += plogp[c + 1] - plogp[c]
        for k, g in enumerate(groups):
            have[k] += ch in g
        if i >= width:
            old = text[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += plogp[c - 1] - plogp[c]
            for k, g in enumerate(groups):
                have[k] -= old in g
        if i >= width - 1 and math.log2(width) - total / width >= cls.bits and all(h >= n for h, (_, n) in zip(have, cls.needs)):
            if i - width + 1 > last:
                if last >= 0:
                    yield first, last
                first = i - width + 1
            last = i + 1
    if last >= 0:
        yield first, last


def entropy_spans(text: str, allowed: tuple[re.Pattern, ...] = ALLOWED) -> list[tuple[int, int]]:
    """Merged spans of high entropy over the whole text, by start."""
    found: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        run = m.group()
        if not _DIGIT.search(run) or any(p.fullmatch(run) for p in allowed):
            continue
        apart, within = harmless(run)
        here, merged, at = [], [], 0  # windows are merged as they come, so that few spans are held
        for start, end in [*apart, (len(run), len(run))]:
            part = run[at:start]
            classes = [c for c in CLASSES if c.name != "base64url" or not plain(part)] if len(part) >= WIDTH else []
            here += [(at + s.start() + a, at + s.start() + b) for c in classes for s in _STRETCH[c.name].finditer(part) for a, b in windows_above(s.group(), c)]
            at = max(at, end)
        for a, b in sorted(here):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        # Placeholders do not overlap: of those that begin before b, the last one ends last.
        begun, ends = [x for x, _ in within], [0, *(y for _, y in within)]
        found += [(m.start() + a, m.start() + b) for a, b in merged if ends[bisect_left(begun, b)] <= a]
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the entropy spans that no base span holds."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], [0, *accumulate((b for _, _, b in base), max)]
    # A base span holds (a, b) if one that starts no later than a reaches b.
    more = [(a, 3, b) for a, b in entropy_spans(text) if reach[bisect_right(starts, a)] < b]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with each merged run of spans replaced by the mark."""
    parts, at = [], 0
    for a, _, b in all_spans(text)[1]:
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts by base kind, base_sha256 and spans (both as kind:start:end lists) for each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "")
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    id_field = docs.schema[id_col]
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    schema = T.StructType([T.StructField(id_col, id_field.dataType), *(T.StructField(n, T.LongType()) for n in names[1:4]), *(T.StructField(n, T.StringType()) for n in names[4:])])
    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced in the text, and the length column, if there is one, brought in line."""
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            before = columns[at].to_pylist()
            after = [None if x is None else redact(x) for x in before]
            columns[at] = pa.array(after, columns[at].type)
            if count_at is not None:
                old = columns[count_at].to_pylist()
                columns[count_at] = pa.array([o if x == y else len(y) for x, y, o in zip(before, after, old)], columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
