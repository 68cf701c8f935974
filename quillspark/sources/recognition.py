"""Pictures and tables inside of files, and what is read from them.

Libraries for PDF and HWP files are optional, and models for text recognition and vision sit behind small
interfaces; `plain_gray` and `marks_reader` are stand-ins, so that all of it runs without them.
"""

from __future__ import annotations

import io
import json
import re
from typing import Callable, NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.images import line_runs
from . import hwp

# The kinds of pictures, and the ways of reading them.
KINDS = ("diagram", "form", "table", "chart", "logo", "photo", "other")
MODES = ("openai_only", "paddle_openai", "paddle_qwen")


class Box(NamedTuple):
    """A piece of text and its place in pixels."""

    text: str
    left: int
    top: int
    right: int
    bottom: int


class TextReader(Protocol):
    """A grey picture to its pieces of text, in reading order."""

    def __call__(self, gray: np.ndarray) -> list[Box]: ...


class VisionModel(Protocol):
    """A picture and a prompt to the model's text."""

    def __call__(self, content: bytes, prompt: str) -> str: ...


def plain_gray(content: bytes) -> np.ndarray:
    """A binary grey map (P5) as an array; other formats by Pillow, where it is installed."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", content)
    if m:
        w, h = int(m.group(1)), int(m.group(2))
        return np.frombuffer(content, np.uint8, w * h, m.end()).reshape(h, w)
    from PIL import Image

    with Image.open(io.BytesIO(content)) as image:
        return np.asarray(image.convert("L"))


def marks_reader(gray: np.ndarray) -> list[Box]:
    """A stand-in for text recognition: a picture with dark pixels reads as their number, one without as nothing."""
    dark = gray < 128
    if not dark.any():
        return []
    rows, columns = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    return [Box(f"m{int(dark.sum())}", int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1)]


def markdown(rows: list[list[str | None]]) -> str:
    """Rows of cells as a Markdown table of the first row's width; fewer than two rows are none."""
    if len(rows) < 2:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join((c or "").replace("|", "\\|").replace("\n", " ").strip() for c in [*r, *[""] * width][:width]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def read_cells(gray: np.ndarray, reader: TextReader, dark: int = 128, share: float = 0.5, lines: int = 2, least: int = 2, margin: int = 2, smallest: tuple[int, int] = (4, 4)) -> str:
    """The table between the lines of a picture as Markdown, read cell by cell; '' without a grid. Cells that are
    not larger than `smallest` (width, height) are empty."""
    if gray.size == 0:
        return ""
    black = gray < dark
    across, down = ([int(c) for c in line_runs(black.mean(axis=a) > share, least)] for a in (1, 0))
    if len(across) < lines or len(down) < lines:
        return ""
    read = lambda t, b, l, r: "" if r - l <= smallest[0] or b - t <= smallest[1] else " ".join(x.text for x in reader(gray[t + margin : b, l + margin : r])).strip().replace("\n", " ")  # noqa: E731, E741
    return markdown([[read(t, b, l, r) for l, r in zip(down, down[1:])] for t, b in zip(across, across[1:])])


def read_table(gray: np.ndarray, reader: TextReader, **settings) -> tuple[str, str]:
    """(markdown, text): the table cell by cell; where no cell reads, the text of the whole picture instead."""
    table = read_cells(gray, reader, **settings)
    return (table, "") if re.search(r"[^\s|\-]", table) else ("", "\n".join(b.text for b in reader(gray)))


# -- what files hold

def pdf_tables(content: bytes, opener: Callable | None = None) -> list[tuple[int, int, str]]:
    """(page, number on the page, markdown), both from 1, of the tables in a PDF file; those of one row are left
    out. The opener gives an object with pages that have extract_tables(); needs pdfplumber without one."""
    if opener is None:
        import pdfplumber

        opener = pdfplumber.open
    with opener(io.BytesIO(content)) as pdf:
        found = [(p, n, markdown(rows)) for p, page in enumerate(pdf.pages, 1) for n, rows in enumerate(page.extract_tables() or [], 1)]
    return [x for x in found if x[2]]


def pdf_pictures(content: bytes, opener: Callable | None = None) -> list[tuple[int, int, bytes]]:
    """(page, number on the page, bytes) of the pictures in a PDF file; needs pypdf without an opener."""
    if opener is None:
        from pypdf import PdfReader as opener
    return [(p, n, i.data) for p, page in enumerate(opener(io.BytesIO(content)).pages, 1) for n, i in enumerate(page.images, 1)]


def thin_pages(content: bytes, render: Callable[[bytes, int], bytes], opener: Callable | None = None, least: int = 20) -> list[tuple[int, int, bytes]]:
    """(page, 0, picture) of the pages of a PDF file with fewer than `least` characters of text, drawn by render."""
    if opener is None:
        from pypdf import PdfReader as opener
    pages = opener(io.BytesIO(content)).pages
    return [(p, 0, render(content, p)) for p, page in enumerate(pages, 1) if len((page.extract_text() or "").strip()) < least]


def ole_streams(content: bytes, folder: str) -> dict[str, bytes]:
    """The streams of one folder of an OLE file by name; needs olefile."""
    import olefile

    with olefile.OleFileIO(io.BytesIO(content)) as f:
        return {"/".join(e): f.openstream(e).read() for e in f.listdir() if e[0] == folder}


def hwp_pictures(content: bytes, streams: Callable[[bytes, str], dict[str, bytes]] = ole_streams) -> list[tuple[None, int, bytes]]:
    """(null, number, bytes) of the pictures in an HWP file, in the order of their stream names; streams that hold
    none are left out and take no number."""
    found = [hwp.find_picture(data) for _, data in sorted(streams(content, "BinData").items())]
    return [(None, n, p) for n, p in enumerate((p for p in found if p is not None), 1)]


def pictures(files: DataFrame, finders: dict[str, Callable[[bytes], list]] | None = None) -> DataFrame:
    """(path, page_number, image_number, content, error) of (path, content): the pictures of each file by its
    suffix. A file without a finder, or one that cannot be read, gives one row with its error."""
    known = finders or {"pdf": pdf_pictures, "hwp": hwp_pictures}

    def one(path: str, content: bytes):
        suffix = path.rpartition(".")[2].lower()
        try:
            if suffix not in known:
                raise ValueError(f"no pictures of .{suffix}")
            return [(path, p, n, c, None) for p, n, c in known[suffix](content)]
        except Exception as e:  # noqa: BLE001 - each file fails for itself
            return [(path, None, None, None, f"{type(e).__name__}: {e}")]

    def run(it):
        for b in it:
            rows = [x for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in one(p, c)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "page_number", "image_number", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_number int, image_number int, content binary, error string")


# -- reading pictures

def parse_extraction(answer: str) -> tuple[str, str, str]:
    """(text, kind, summary) of a model's answer in JSON; ValueError where it breaks the contract."""
    try:
        x = json.loads(answer)
    except json.JSONDecodeError as e:
        raise ValueError(f"no JSON: {e}") from e
    if not isinstance(x, dict) or set(x) != {"text", "image_type", "summary"} or not all(isinstance(v, str) for v in x.values()) or x["image_type"] not in KINDS:
        raise ValueError("the answer breaks the contract")
    return x["text"].strip(), x["image_type"], x["summary"]


def recognize(images: DataFrame, mode: str, vision: VisionModel, reader: TextReader = marks_reader, gray: Callable[[bytes], np.ndarray] = plain_gray, key: str = "record_id") -> DataFrame:
    """(key, ocr_text, boxes, vlm_text, error) of (key, content): what is read from each picture.

    'openai_only' asks the vision model once, for JSON with text, kind and summary, and has no boxes; the other
    modes read the text with the reader and give it to the vision model. A picture that fails has its error
    and nulls. Null contents fail."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    box = pa.struct([("text", pa.string()), ("x_left", pa.int32()), ("y_top", pa.int32()), ("x_right", pa.int32()), ("y_bottom", pa.int32())])

    def one(content: bytes):
        try:
            if mode == "openai_only":
                text, kind, summary = parse_extraction(vision(content, ""))
                return text, [], f"유형: {kind}\n요약: {summary}", None
            boxes = reader(gray(content))
            text = "\n".join(b.text for b in boxes).strip()
            return text, [dict(zip(("text", "x_left", "y_top", "x_right", "y_bottom"), b)) for b in boxes], vision(content, text), None
        except Exception as e:  # noqa: BLE001 - each picture fails for itself
            return None, None, None, f"{type(e).__name__}: {e}"

    def run(it):
        for b in it:
            cols = list(zip(*map(one, b.column(1).to_pylist()))) or [()] * 4
            kinds = [pa.string(), pa.list_(box), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "ocr_text", "boxes", "vlm_text", "error"])

    return images.select(key, "content").mapInArrow(run, f"{key} {dict(images.dtypes)[key]}, ocr_text string, boxes array<struct<text:string,x_left:int,y_top:int,x_right:int,y_bottom:int>>, vlm_text string, error string")
