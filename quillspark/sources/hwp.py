"""Text, sections, tables and pictures of word processor files (HWP 5), from their record streams.

A file is a compound document whose streams BodyText/SectionN hold records: a 32-bit head with a tag
(10 bits), a nesting level (10 bits) and a size (12 bits; 0xFFF means that a 32-bit size follows). The
parsing of records is plain Python over bytes and runs inside `mapInArrow`; reading the compound
document needs the optional library olefile.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the file format: tags of records, and control characters that are one unit long.
PARA_HEADER, PARA_TEXT, CTRL_HEADER, LIST_HEADER, TABLE = 66, 67, 71, 72, 77
SINGLE_UNIT = {9, 10, 13, 24, 30, 31}
TITLE_LENGTH = 40


@dataclass
class Cell:
    row: int
    column: int
    row_span: int
    column_span: int
    text: list[str] = field(default_factory=list)


@dataclass
class Table:
    rows: int
    columns: int
    depth: int
    cells: list[Cell] = field(default_factory=list)

    def density(self) -> float:
        return sum(bool(c.text) for c in self.cells) / len(self.cells) if self.cells else 0.0


def records(stream: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload) of a stream; ends at a head that doesn't fit any more."""
    at = 0
    while at + 4 <= len(stream):
        (head,) = struct.unpack_from("<I", stream, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(stream):
                return
            (size,) = struct.unpack_from("<I", stream, at)
            at += 4
        yield head & 0x3FF, head >> 10 & 0x3FF, stream[at : at + size]
        at += size


def plain(text: str) -> str:
    """Text without control characters: line ends stay, other single ones become a space, the rest take
    seven more units with them."""
    out, skip = [], 0
    for c in text:
        n = ord(c)
        if skip:
            skip -= 1
        elif n >= 32:
            out.append(c)
        elif n in SINGLE_UNIT:
            out.append("\n" if n in (10, 13) else " ")
        else:
            skip = 7
    return "".join(out).strip()


def paragraph(payload: bytes) -> str:
    return plain(payload.decode("utf-16-le", "ignore"))


def cell_head(payload: bytes) -> tuple[int, int, int, int] | None:
    """(column, row, column span, row span) of a cell; None if the record is too short for one."""
    return struct.unpack_from("<4H", payload, 8) if len(payload) >= 16 else None


def content(stream: bytes) -> list[str | Table]:
    """Paragraphs and outermost or nested tables in the order of the stream."""
    out: list[str | Table] = []
    open_tables: list[tuple[int, Table]] = []
    for tag, level, data in records(stream):
        while open_tables and level <= open_tables[-1][0]:
            open_tables.pop()
        if tag == TABLE and len(data) >= 8:
            rows, columns = struct.unpack_from("<2H", data, 4)
            t = Table(rows, columns, len(open_tables))
            # cells and their paragraphs follow at the level of the table's own record or below
            open_tables.append((level - 1, t))
            out.append(t)
        elif tag == LIST_HEADER and open_tables:
            if head := cell_head(data):
                column, row, column_span, row_span = head
                open_tables[-1][1].cells.append(Cell(row, column, row_span, column_span))
        elif tag == PARA_TEXT:
            text = paragraph(data)
            if text:
                if open_tables and open_tables[-1][1].cells:
                    open_tables[-1][1].cells[-1].text.append(text)
                else:
                    out.append(text)
    return out


def is_content(t: Table, min_rows: int = 2, min_columns: int = 2, min_density: float = 0.2) -> bool:
    return t.rows >= min_rows and t.columns >= min_columns and t.density() >= min_density


def sections(parts: list[str | Table], title_length: int = TITLE_LENGTH) -> list[tuple[str, str]]:
    """(title, text) by layout tables: a short one titles what follows, a long one is text of its own under
    no title; content tables are left to the table operators. Sections without text are dropped."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for p in parts:
        if isinstance(p, str):
            out[-1][1].append(p)
        elif not is_content(p):
            text = " ".join(x for c in p.cells for x in c.text).strip()
            if text:
                out.append((text, []) if len(text) <= title_length else ("", [text]))
    return [(t, "\n".join(x)) for t, x in out if x]


def section_number(name: str) -> int:
    m = re.search(r"(\d+)$", name)
    return int(m.group(1)) if m else 0


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data, -15)


def body_streams(raw: bytes) -> list[bytes]:
    """The streams of the body in their order, unpacked. Needs olefile."""
    import io

    import olefile

    with olefile.OleFileIO(io.BytesIO(raw)) as f:
        packed = bool(f.openstream("FileHeader").read()[36] & 1)
        names = sorted((e for e in f.listdir() if e[0] == "BodyText"), key=lambda e: section_number(e[-1]))
        data = [f.openstream(e).read() for e in names]
    return [inflate(d) for d in data] if packed else data


# How picture files begin.
PICTURES = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff")


def find_picture(payload: bytes) -> bytes | None:
    """The picture in a stream, as stored or packed, from its first known beginning on."""
    for read in (lambda x: x, inflate, zlib.decompress):
        try:
            data = read(payload)
        except zlib.error:
            continue
        at = [i for s in PICTURES if (i := data.find(s)) >= 0]
        if at:
            return data[min(at) :]
    return None


def body_text(parts: list[str | Table], exclude_tables: bool = False) -> str:
    """Paragraphs and the cells of tables, line by line; without those of content tables if asked, while the text
    of layout tables stays where it stands."""
    keep = (p for p in parts if isinstance(p, str) or not (exclude_tables and is_content(p)))
    return "\n".join(p if isinstance(p, str) else "\n".join(x for c in p.cells for x in c.text) for p in keep)


def parse_streams(df: DataFrame, exclude_tables: bool = False) -> DataFrame:
    """(key, text, sections, tables, error) of (key, streams array<binary>); a document that can't be read
    gives its error and does not end the task. exclude_tables leaves content tables out of the text."""
    table_type = pa.struct([("rows", pa.int32()), ("columns", pa.int32()), ("depth", pa.int32()), ("density", pa.float64()), ("cells", pa.list_(pa.struct([("row", pa.int32()), ("column", pa.int32()), ("text", pa.list_(pa.string()))])))])
    section_type = pa.struct([("title", pa.string()), ("text", pa.string())])

    def run(it):
        for b in it:
            rows = []
            for key, streams in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    parts = [p for s in streams or [] for p in content(s)]
                    tables = [{"rows": t.rows, "columns": t.columns, "depth": t.depth, "density": t.density(), "cells": [{"row": c.row, "column": c.column, "text": c.text} for c in t.cells]} for t in parts if isinstance(t, Table)]
                    rows.append((key, body_text(parts, exclude_tables), [{"title": a, "text": x} for a, x in sections(parts)], tables, None))
                except Exception as e:  # noqa: BLE001 - each document fails for itself
                    rows.append((key, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.list_(section_type), pa.list_(table_type), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "text", "sections", "tables", "error"])

    return df.select("key", "streams").mapInArrow(run, "key string, text string, sections array<struct<title:string,text:string>>, tables array<struct<rows:int,columns:int,depth:int,density:double,cells:array<struct<row:int,column:int,text:array<string>>>>>, error string")
