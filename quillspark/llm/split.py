"""Problem 1: splitting oversized items at natural boundaries.

Method: agglomerative merging. An item is cut into atomic segments; adjacent pairs lie in a heap
by the strength of the boundary between them, and the weakest boundaries are merged first while
the combined size plus the overlap stays within the limit. What is left are the cuts.

Only items over the limit reach Python; the length test runs in the scan.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 800, 120
#: Strengths of boundaries, the weakest first: within a word, word, clause, sentence, line, paragraph.
FORCED, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_TEXT_CUTS = re.compile(r"\r?\n(?:[ \t]*\r?\n)+|\r?\n|(?<=[.!?])\s+")
_ROW_CUTS = re.compile(r"\r\n|\n|\r")
_TABLE_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\Z")
_FINE_CUTS = re.compile(r"(?<=[,;:·|)\]])\s+|<br>|\s+")
_SEPARATOR = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$")


def table_head(table: str) -> tuple[str, str, list[str]]:
    """(head with its line end, rest, rows): the header line, the separator line if any, and the rows."""
    lines = _TABLE_LINE.findall(table)
    n = 1 + (len(lines) > 1 and _SEPARATOR.match(lines[1].strip()) is not None)
    head, rows = "".join(lines[:n]), lines[n:]
    return head, "".join(rows), [r.rstrip("\r\n") for r in rows]


def _segments(body: str, cuts: re.Pattern, limit: int, fine_limit: int) -> tuple[list[int], list[int]]:
    """Starts of atomic segments, and the strength of the boundary before each: units of at most `limit`
    (not counting white space around them) as they are, longer ones in segments of at most `fine_limit`."""
    starts, strong = [0], [PARAGRAPH]

    def add(at: int, s: int) -> None:
        if starts[-1] < at < len(body):
            starts.append(at)
            strong.append(s)

    for m in cuts.finditer(body):
        g = m.group()
        add(m.end(), SENTENCE if not set(g) & set("\r\n") else PARAGRAPH if g.count("\n") > 1 else LINE)
    out, why = [], []
    for i, a in enumerate(starts):
        b = starts[i + 1] if i + 1 < len(starts) else len(body)
        out.append(a)
        why.append(strong[i])
        unit = body[a:b]
        if len(unit.rstrip("\r\n") if cuts is _ROW_CUTS else unit.strip()) > limit:  # no natural cut within the limit: words, else characters
            last = a
            fine = [(m.end(), CLAUSE if m.group() == "<br>" or body[m.start() - 1] in ",;:·|)]" else WORD) for m in _FINE_CUTS.finditer(body, a + 1, b)]
            for at, s in [*fine, (b, None)]:
                while at - last > fine_limit:
                    last += fine_limit
                    out.append(last)
                    why.append(FORCED)
                if s is not None and last < at < b:
                    out.append(at)
                    why.append(s)
                    last = at
    return out, why


def merge(sizes: list[int], strong: list[int], limit: int, overlap: int) -> list[int]:
    """Indices of the segments that begin a piece, by merging over the weakest boundaries first.

    A piece may hold `limit` characters; every merged piece but the first also leaves room for `overlap`
    of the piece before it. A segment that is too large for that stays alone.
    """
    n = len(sizes)
    size, left, right, alive = list(sizes), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(strong[i], sizes[i - 1] + sizes[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, total, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        p = left[i]
        if size[p] + size[i] != total:  # grown since: another entry holds the present size
            continue
        if total + (overlap if p else 0) > limit:
            continue
        alive[i] = False
        size[p] = total
        right[p] = right[i]
        if right[i] < n:
            left[right[i]] = p
            heapq.heappush(heap, (strong[right[i]], total + size[right[i]], right[i]))
        if p:
            heapq.heappush(heap, (strong[p], size[left[p]] + total, p))
    return [i for i in range(n) if alive[i]]


def repeats_head(head: str, rows: list[str], limit: int) -> bool:
    """Whether the pieces of a table can repeat its head: every row fits beside it, or it leaves a quarter of
    the limit at least for the parts of longer rows."""
    room = limit - len(head)
    return bool(rows) and room > 0 and (room >= limit // 4 or all(len(r) <= room for r in rows if r.strip()))


def split_item(kind: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool, str]]:
    """Pieces (start, end, overlap, natural, piece) of an item longer than the limit.

    start and end are offsets in the stored text and do not hold the overlap, so that the pieces'
    spans follow each other without gap. natural tells whether the cut before the piece lies between
    units: sentences or lines of a text, rows with their head of a table. A piece of a table repeats the
    header and separator lines (see `repeats_head`; without them, no cut is natural) and overlaps by whole
    rows only; a piece of a text overlaps by exactly `overlap` characters, or by the whole piece before it
    if that is shorter, or by what the limit leaves beside a single longer unit. White space at the ends of
    a piece is left out where the piece would exceed the limit otherwise.
    """
    head, base, cuts, whole = "", 0, _TEXT_CUTS, True
    body = text
    if kind == "table":
        h, rest, rows = table_head(text)
        whole = repeats_head(h, rows, limit)
        if whole:
            head, base, body = h, len(h), rest
        cuts = _ROW_CUTS
    room = limit - len(head)
    over = min(overlap, room // 2)
    starts, strong = _segments(body, cuts, room, max(1, room - over))
    ends = [*starts[1:], len(body)]
    firsts = merge([b - a for a, b in zip(starts, ends)], strong, room, over)
    out = []
    for k, i in enumerate(firsts):
        a, b = starts[i], starts[firsts[k + 1]] if k + 1 < len(firsts) else len(body)
        o = 0
        if k:
            before = starts[firsts[k - 1]]
            o = max(0, min(over, a - before, room - (b - a)))
            if kind == "table":
                own = [s for s, w in zip(starts, strong) if a - o <= s < a and w >= LINE]
                o = a - own[0] if own else 0
        piece = head + body[a - o : b]
        if len(piece) > limit:
            piece = head + body[a - o : b].strip()
        if len(piece) > limit:
            raise AssertionError(f"a piece of {len(piece)} characters")
        # the head of a table belongs to the span of its first piece
        out.append((base + a if k or not head else 0, base + b, o, not k or (whole and strong[i] >= SENTENCE), piece))
    return out


def oversized(chunks: DataFrame, tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_kind, item_id, text) of every chunk text and table over the limit, repeated rows once."""
    c = chunks.where(F.length("text") > limit).select(F.lit("text").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    t = tables.where(F.length("table_markdown") > limit).select(F.lit("table").alias("item_kind"), F.col("record_id").cast("string").alias("item_id"), F.col("table_markdown").alias("text"))
    return c.union(t).dropDuplicates(["item_kind", "item_id"])


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the items (item_kind, item_id, text), one row per piece.

    Null and short texts must be filtered before (see `oversized`); other columns are dropped.
    An item without any natural boundary is cut between characters. cut_kind is 'forced' if any of the cuts
    made lies within a unit, else 'natural'. Output: item_kind, item_id, piece_no from 1, n_pieces,
    start_at, end_at, overlap_chars, n_chars, cut_kind, piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and the limit")

    def run(it):
        for batch in it:
            rows = []
            for kind, key, text in zip(*(batch.column(c).to_pylist() for c in ("item_kind", "item_id", "text"))):
                pieces = split_item(kind, text, limit, overlap)
                cut = "natural" if all(x[3] for x in pieces) else "forced"
                rows += [(kind, key, i + 1, len(pieces), a, b, o, len(p), cut, p) for i, (a, b, o, _, p) in enumerate(pieces)]
            cols = list(zip(*rows)) or [()] * 10
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.string(), pa.string()]
            names = ["item_kind", "item_id", "piece_no", "n_pieces", "start_at", "end_at", "overlap_chars", "n_chars", "cut_kind", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return items.select("item_kind", "item_id", "text").mapInArrow(
        run, "item_kind string, item_id string, piece_no int, n_pieces int, start_at int, end_at int, overlap_chars int, n_chars int, cut_kind string, piece string"
    )


def found(chunks: DataFrame, tables: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_id, cut_kind) of every oversized item, from the pieces it was cut into."""
    return split_oversized(oversized(chunks, tables, limit), limit, overlap).where("piece_no = 1").select("item_kind", "item_id", "cut_kind")
