import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import tables as ft, text as fx

SAMPLES = [
    "", " ", "a", "\n\n a \n\n\n b\t\tc \n", "같은 줄이다 같은 줄\n같은 줄이다 같은 줄\n같은 줄이다 같은 줄\n짧다\n짧다", "\ue000가항목\n \uf0b7나\u3000 다",
    "\u00adx\x00y\u200bz\u3000끝\x1c", "SFR-123 SFR-123 ABCDE-1234 AB-12 12,345원", "x" * 2500, "A  B\r\nC", "\t \x1b",
]


def rows(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_tokens(spark):
    got = [r[0] for r in rows(spark, SAMPLES, fx.tokens("t"))]
    assert got == [[x.lower() for x in re.findall("[0-9A-Za-z가-힣]+", s)] for s in SAMPLES]


@pytest.mark.parametrize("size,overlap", [(800, 120), (10, 3), (7, 7), (5, 9)])
def test_windows(spark, size, overlap):
    def brute(s):
        s, out, at = " ".join(s.split()), [], 0
        while at < len(s):
            out.append(s[at : at + size])
            if at + size >= len(s):
                break
            at += max(size - overlap, 1)
        return out

    got = [[w["text"] for w in r[0]] for r in rows(spark, SAMPLES, fx.windows("t", size, overlap))]
    assert got == [brute(s) for s in SAMPLES]


def test_repeated_lines_and_blank_lines(spark):
    def dedup(s):
        kept, gone = [], []
        for x in s.split("\n"):
            (gone if kept and x == kept[-1] and len(" ".join(x.split())) >= 8 else kept).append(x)
        return "\n".join(kept), len(gone), sum(c in "0123456789" for x in gone for c in x)

    def blank(s, most):
        out, run, gone = [], 0, 0
        for x in (re.sub(r"[ \t]{2,}", " ", y).strip() for y in s.split("\n")):
            run = 0 if x else run + 1
            if x or run <= most:
                out.append(x)
            else:
                gone += 1
        return "\n".join(out).strip(), gone

    got = [tuple(r[0]) for r in rows(spark, SAMPLES, fx.drop_repeated_lines("t"))]
    assert got == [dedup(s) for s in SAMPLES]
    for most in (0, 1, 2):
        assert [tuple(r[0]) for r in rows(spark, SAMPLES, fx.collapse_blank("t", most))] == [blank(s, most) for s in SAMPLES]


def test_normalized_characters(spark):
    got = {s: tuple(r[0]) for s, r in zip(SAMPLES, rows(spark, SAMPLES, fx.normalize_characters("t")))}
    assert got["\u00adx\x00y\u200bz\u3000끝\x1c"] == ("- xy z 끝", 1, 2, 2)
    assert got["\ue000가항목\n \uf0b7나\u3000 다"] == ("- 가항목\n - 나  다", 2, 0, 1)


def test_cleaning_keeps_what_matters(spark):
    df = spark.createDataFrame([(1, "금액 1,000원 SFR-123\n금액 1,000원 SFR-123", ["1,000원", "없는 값"]), (2, None, None)], "i int, text string, v array<string>")
    c = fx.clean(df)
    r = c.select("i", "clean", fx.preservation("text", "clean.text", "v", "clean.n_digits").alias("p")).orderBy("i").collect()
    assert r[0]["clean"]["text"] == "금액 1,000원 SFR-123" and r[0]["p"]["preserved"] and r[0]["p"]["checked_values"] == 1
    assert r[1]["clean"] is None
    lost = df.where("i = 1").select(fx.preservation("text", F.lit("금액"), "v", F.lit(0)).alias("p")).first()["p"]
    assert not lost["preserved"] and lost["lost_ids"] == ["SFR-123"] and lost["lost_values"] == ["1,000원"] and lost["digit_loss"] == 14


def test_amount_forms(spark):
    got = [r[0] for r in rows(spark, ["12,500원", "980000", None, "", "별도"], fx.amount_forms("t"))]
    assert got == [["12,500원", "12500", "12,500"], ["980000", "980,000"], [], [], ["별도"]]


def test_markdown(spark):
    df = spark.createDataFrame([([["h", "k"], ["a|b", None, "extra"], ["x\ny"]],), ([["only"]],), ([],)], "r array<array<string>>")
    got = [r[0] for r in df.select(ft.rows_markdown("r")).collect()]
    assert got == ["| h | k |\n| --- | --- |\n| a\\|b |  |\n| x y |  |", "", ""]
    back = spark.createDataFrame([(got[0],)], "m string").select(ft.markdown_rows("m")).first()[0]
    assert back == [["h", "k"], ["a|b", ""], ["x y", ""]]


def test_grid(spark):
    cells = [(0, 0, ["a"]), (0, 1, ["b", "c"]), (1, 0, []), (1, 1, ["d"]), (1, 1, ["e"]), (9, 9, ["out"])]
    df = spark.createDataFrame([(2, 2, cells), (0, 2, [])], "n int, m int, c array<struct<row:int,column:int,text:array<string>>>")
    assert [r[0] for r in df.select(ft.grid_markdown("n", "m", "c")).collect()] == ["| a | b c |\n|  | d e |", ""]


@pytest.mark.parametrize("expression,value,error", [
    ("1 + 2 * 3", 7, None), ("(500-320)/320*100", 56.25, None), ("-(-2)", 2, None), ("1/0", None, "division_by_zero"), ("__import__('os')", None, "not_arithmetic"),
    ("2 ** 9", None, "not_arithmetic"), ("a + 1", None, "not_arithmetic"), ("", None, "not_arithmetic"), (None, None, None), ("True + 1", None, "not_arithmetic"),
])
def test_calculator(expression, value, error):
    assert ft.evaluate(expression) == (value, error)


@settings(max_examples=60, suppress_health_check=[HealthCheck.too_slow])
@given(st.recursive(st.integers(1, 99).map(str), lambda x: st.tuples(x, st.sampled_from("+-*/"), x).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), max_leaves=8))
def test_calculator_agrees_with_python(expression):
    try:
        want = float(eval(expression))
    except ZeroDivisionError:
        assert ft.evaluate(expression) == (None, "division_by_zero")
    else:
        assert ft.evaluate(expression) == (want, None)


def test_image_texts(spark):
    df = spark.createDataFrame([("유형: Chart 요약: 비용 추이\n둘째",), ("a form here",), ("",), (None,)], "v string")
    got = [tuple(r) for r in df.select(ft.image_type("v"), ft.image_headline(F.lit("chart"), "v")).collect()]
    assert got == [("chart", "[chart] 비용 추이 둘째\n"), ("form", "[chart] a form here\n"), ("other", "[chart]\n"), ("other", "[chart]\n")]
