"""Functions over tables, images and expressions: Markdown, cell grids, types, arithmetic."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import _col


def rows_markdown(rows) -> Column:
    """A Markdown table of array<array<string>>: the first row is the header and gives the width; other
    rows are padded or cut to it. Pipes are escaped, line breaks become spaces. Fewer than two rows give ''."""
    r = F.filter(_col(rows), lambda x: F.size(x) > 0)
    cell = lambda x: F.trim(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    width = F.size(F.get(r, F.lit(0)))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.transform(F.slice(F.concat(x, F.array_repeat(F.lit(""), width)), F.lit(1), width), cell), " | "), F.lit(" |"))
    head = F.get(r, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), line)
    return F.when(F.size(r) < 2, "").otherwise(F.array_join(F.concat(F.array(line(head), rule), body), "\n"))


def markdown_rows(markdown) -> Column:
    """The cells of a Markdown table as array<array<string>>, without its separator line."""
    lines = F.filter(F.split(F.replace(_col(markdown), F.lit("\r")), "\n", -1), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"(?<!\\)\|", -1), lambda y: F.replace(F.trim(y), F.lit("\\|"), F.lit("|"))))


def grid_markdown(n_rows, n_columns, cells) -> Column:
    """A grid of cells array<struct<row,column,text array<string>>> by their coordinates, as Markdown
    without separator. Cells outside are skipped, those on one seat are joined by a space."""
    c = _col(cells)
    seat = lambda i, j: F.trim(F.array_join(F.filter(F.transform(F.filter(c, lambda x: (x["row"] == i) & (x["column"] == j)), lambda x: F.array_join(x["text"], " ")), lambda x: x != ""), " "))
    line = lambda i: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), _col(n_columns) - 1), lambda j: seat(i, j)), " | "), F.lit(" |"))
    return F.when((_col(n_rows) <= 0) | (_col(n_columns) <= 0), "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), _col(n_rows) - 1), line), "\n"))


def cell_density(cells) -> Column:
    """Share of the cells (array<array<string>> or of structs with text) that hold text; 0 without cells."""
    flat = F.flatten(_col(cells))
    return F.when(F.size(flat) > 0, F.size(F.filter(flat, lambda x: F.trim(x) != "")) / F.size(flat)).otherwise(0.0)


def is_content_table(n_rows, n_columns, density, min_rows: int = 2, min_columns: int = 2, min_density: float = 0.2) -> Column:
    """Whether a table is content and not layout; null measures count as too small."""
    return F.coalesce((_col(n_rows) >= min_rows) & (_col(n_columns) >= min_columns) & (_col(density) >= min_density), F.lit(False))


def table_drop_reason(n_rows, n_columns, density, min_rows: int = 2, min_columns: int = 2, min_density: float = 0.2) -> Column:
    """Why a table is no content: layout_table or low_density; null if it is one."""
    small = F.coalesce((_col(n_rows) < min_rows) | (_col(n_columns) < min_columns), F.lit(True))
    return F.when(small, "layout_table").when(F.coalesce(_col(density) < min_density, F.lit(True)), "low_density")


# The types of images that an answer may name.
IMAGE_TYPES = "diagram|form|table|chart|logo|photo|other"


def image_type(answer) -> Column:
    """The type in a line that opens with its label, else the first word that is a type, else 'other'."""
    a = F.coalesce(_col(answer), F.lit(""))
    labelled = F.regexp_extract(a, rf"(?im)^(?:유형|type)\s*[:：]\s*({IMAGE_TYPES})\b", 1)
    anywhere = F.regexp_extract(a, rf"(?i)\b({IMAGE_TYPES})\b", 1)
    return F.lower(F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(anywhere, F.lit("")), F.lit("other")))


def image_headline(image_type_col, answer) -> Column:
    """The first line of an image's chunk: its type and the summary of the answer, if any."""
    s = F.trim(F.replace(F.coalesce(_col(answer), F.lit("")), F.lit("\n"), F.lit(" ")))
    s = F.when(F.contains(s, F.lit("요약:")), F.trim(F.substring(s, F.instr(s, "요약:") + 3, F.length(s)))).otherwise(s)
    t = F.concat(F.lit("["), F.coalesce(_col(image_type_col), F.lit("unclassified")), F.lit("]"))
    return F.when(s == "", F.concat(t, F.lit("\n"))).otherwise(F.concat(t, F.lit(" "), s, F.lit("\n")))


def combined_context(ocr_text, layout_rows, answer) -> Column:
    """What was read, its rows on the page, and the model's outline, as paragraphs; parts without content
    are left out but for the first."""
    r = F.coalesce(_col(layout_rows), F.array())
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.lit("행 "), x["row_index"].cast("string"), F.lit(": "), F.array_join(F.transform(x["items"], lambda y: y["text"]), " | "))), "\n")
    part2 = F.when(F.size(r) > 0, F.concat(F.lit("공간 배치(화살표 흐름 아님):\n"), lines))
    part3 = F.when(F.coalesce(_col(answer), F.lit("")) != "", F.concat(F.lit("검토 필요 VLM 개요:\n"), _col(answer)))
    return F.concat_ws("\n\n", F.concat(F.lit("이미지 OCR 텍스트:\n"), F.coalesce(_col(ocr_text), F.lit(""))), part2, part3)


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def evaluate(expression: str | None) -> tuple[float | None, str | None]:
    """(value, error) of an expression of numbers, + - * / and parentheses; anything else is an error."""
    if expression is None:
        return None, None
    todo: list = []
    try:
        tree = ast.parse(expression.strip(), mode="eval").body
        # post-order over the tree; a node that isn't arithmetic stops it
        stack, order = [tree], []
        while stack:
            node = stack.pop()
            order.append(node)
            if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
                stack += [node.left, node.right]
            elif isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
                stack.append(node.operand)
            elif not (isinstance(node, ast.Constant) and type(node.value) in (int, float)):
                return None, "not_arithmetic"
        for node in reversed(order):
            if isinstance(node, ast.Constant):
                todo.append(node.value)
            elif isinstance(node, ast.UnaryOp):
                todo.append(_UNARY[type(node.op)](todo.pop()))
            else:
                right, left = todo.pop(), todo.pop()
                todo.append(_BINARY[type(node.op)](left, right))
        return float(todo.pop()), None
    except ZeroDivisionError:
        return None, "division_by_zero"
    except (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError):
        return None, "not_arithmetic"


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())]))
def calculate(expressions: pd.Series) -> pd.DataFrame:
    """Column function of `evaluate`."""
    return pd.DataFrame([evaluate(e) for e in expressions], columns=["value", "error"])
