import io
import json
import zlib

import numpy as np
import pytest

from quillspark import config
from quillspark.functions.tables import evaluate
from quillspark.sources import hwp, parsers, recognition


def p5(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % gray.shape[::-1] + gray.astype(np.uint8).tobytes()


def grid(rows=2, columns=2, size=20) -> np.ndarray:
    g = np.full((rows * size + 3, columns * size + 3), 255, np.uint8)
    for i in range(rows + 1):
        g[i * size : i * size + 3] = 0
    for j in range(columns + 1):
        g[:, j * size : j * size + 3] = 0
    return g


def test_tables_are_read_cell_by_cell():
    g = grid()
    g[8, 8:11] = 0
    g[28, 28] = 0
    inner = lambda x: recognition.marks_reader(x[:-2, :-2])  # cells reach to the middle of the lines after them
    assert recognition.read_cells(g, inner, margin=4) == "| m3 |  |\n| --- | --- |\n|  | m1 |"
    assert recognition.read_cells(np.full((40, 40), 255, np.uint8), recognition.marks_reader) == "" == recognition.read_cells(np.empty((0, 0), np.uint8), recognition.marks_reader)
    # cells too small to read are empty, and a table of empty cells falls back to the whole picture
    assert recognition.read_table(g, recognition.marks_reader, smallest=(50, 50))[0] == "" and recognition.read_table(g, recognition.marks_reader, smallest=(50, 50))[1].startswith("m")
    assert recognition.markdown([["a", None], ["b|c", "d\ne", "x"]]) == "| a |  |\n| --- | --- |\n| b\\|c | d e |" and recognition.markdown([["a"]]) == ""


class Page:
    def __init__(self, text="", tables=(), images=()):
        self.tables, self.text = tables, text
        self.images = [type("I", (), {"data": x}) for x in images]

    def extract_tables(self):
        return self.tables

    def extract_text(self):
        return self.text


class Pdf:
    pages = [Page("x" * 30, [[["h"], ["1"]], [["only"]]], [b"p1", b"p2"]), Page("  \n", None)]

    def __init__(self, _):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_what_pdf_files_hold():
    assert recognition.pdf_tables(b"", Pdf) == [(1, 1, "| h |\n| --- |\n| 1 |")]
    assert recognition.pdf_pictures(b"", Pdf) == [(1, 1, b"p1"), (1, 2, b"p2")]
    assert recognition.thin_pages(b"f", lambda c, p: c + b"%d" % p, Pdf) == [(2, 0, b"f2")]


def test_pictures_of_files(spark):
    png = b"\x89PNG\r\n\x1a\nrest"
    packed = zlib.compressobj(wbits=-15)
    data = {"BinData/BIN0002.png": packed.compress(b"xx" + png) + packed.flush(), "BinData/BIN0001.bmp": b"none", "BinData/BIN0003.png": png}
    finders = {"hwp": lambda c: recognition.hwp_pictures(c, lambda _, folder: data if folder == "BinData" else {}), "bad": lambda c: 1 / 0}
    files = spark.createDataFrame([("a.hwp", b""), ("b.bad", b""), ("c.txt", b""), ("d.hwp", None)], "path string, content binary")
    got = sorted(((r.path, r.image_number, bytes(r.content) if r.content else None, r.error) for r in recognition.pictures(files, finders).collect()), key=str)
    assert got == sorted([("a.hwp", 1, png, None), ("a.hwp", 2, png, None), ("d.hwp", 1, png, None), ("d.hwp", 2, png, None), ("b.bad", None, None, "ZeroDivisionError: division by zero"), ("c.txt", None, None, "ValueError: no pictures of .txt")], key=str)


def test_pictures_are_read(spark):
    g = np.full((10, 12), 255, np.uint8)
    g[2:4, 3:6] = 0
    im = spark.createDataFrame([(1, p5(g)), (2, b"no picture"), (3, None)], "record_id long, content binary")

    def vision(content, prompt):
        return json.dumps({"text": " T ", "image_type": "table", "summary": "S"}) if not prompt else f"seen {prompt}"

    got = {r.record_id: r for r in recognition.recognize(im, "paddle_openai", vision).collect()}
    assert got[1].ocr_text == "m6" and got[1].vlm_text == "seen m6" and got[1].boxes[0].asDict() == {"text": "m6", "x_left": 3, "y_top": 2, "x_right": 6, "y_bottom": 4}
    assert got[2].ocr_text is None and got[2].error and got[3].error
    got = {r.record_id: r for r in recognition.recognize(im, "openai_only", vision).collect()}
    assert got[1].ocr_text == "T" and got[1].vlm_text == "유형: table\n요약: S" and got[1].boxes == []
    for bad in ("x", "[]", '{"text": "", "image_type": "map", "summary": ""}', '{"text": "", "image_type": "form"}'):
        with pytest.raises(ValueError):
            recognition.parse_extraction(bad)
    with pytest.raises(ValueError):
        recognition.recognize(im, "other", vision)


def test_content_tables_can_be_left_out_of_the_text():
    full = hwp.Table(2, 2, 0)
    full.cells += [hwp.Cell(r, c, 1, 1) for r in (0, 1) for c in (0, 1)]
    for c in full.cells:
        c.text.append(f"v{c.row}{c.column}")
    layout = hwp.Table(1, 1, 0)
    layout.cells.append(hwp.Cell(0, 0, 1, 1))
    layout.cells[0].text.append("title")
    parts = ["a", full, layout, "b"]
    assert hwp.body_text(parts) == "a\nv00\nv01\nv10\nv11\ntitle\nb" and hwp.body_text(parts, exclude_tables=True) == "a\ntitle\nb"


def test_answers_with_one_round_of_tools(spark):
    def model(messages):
        if len(messages) == 1:
            return ("direct", []) if "direct" in messages[0] else ("", [("calculate", "2 * (3 + 4)"), ("unknown", "")])
        return "got " + ", ".join(messages[2:]), [("calculate", "1")]

    df = spark.createDataFrame([(1, "direct", "c"), (2, "sum", "c"), (3, "sum", " "), (4, "sum", None)], "id int, prompt string, context string")
    got = {r.id: r.answer for r in parsers.answer_with_tools(df, model, {"calculate": lambda x: evaluate(x)[0]}).collect()}
    assert got[1] == "direct" and got[2].startswith("got 14") and "unknown" in got[2] and got[3] == got[4] == parsers.NOTHING_FOUND


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("chunking:\n  chunk_size: 400\nretrieval:\n  search_method: mmr\n  profile: openai\npaths:\n  data: raw\n", encoding="utf-8")
    s = config.load(str(f))
    assert (s.chunk_size, s.search_method, s.fetch_k, s.paths["data"]) == (400, "mmr", 100, str(tmp_path / "raw"))
    for bad in ("chunk_sise: 1", "search_method: none", "chunk_overlap: 900", "{use_rerank: true, final_top_k: null}"):
        f.write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError):
            config.load(str(f))
