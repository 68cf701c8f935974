"""Nulls in any column, empty tables, repeated rows, very long texts and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import leakage, lookalike, mixture, names, near_dup, qa_pairs, repetition, scans, split, toxicity

SCHEMAS = {
    "chunks": "chunk_id string, doc_id string, text string, metadata map<string,string>, loaded_at timestamp",
    "tables": "record_id long, doc_id string, table_markdown string",
    "images": "record_id long, doc_id string, file_name string, source_type string, image_number int, ocr_text string, combined_context string",
    "questions": "question_id string, question string, filters map<string,string>",
    "results": "result_id long, question string, final_answer string, is_empty boolean",
    "documents": "doc_id long, text string, lang string, source string",
    "items": "item_id long, text string",
    "labels": "doc_id long, label string, reviewer_id int, reviewed_at timestamp",
    "targets": "source string, target_share double, max_repeats int",
}
LONG = "긴 글이 이어진다. " * 20_000
ROWS = {
    "chunks": [("a", "d", LONG, {"agency": "찬호로시청", "project_name": "P"}, None), ("b", "d", LONG, {"agency": "찬호로시"}, None), ("c", "d", "", {}, None), ("e", "d", "\x00 힣 짧다", {"agency": " "}, None), ("f", "d", "한 글", {"agency": ""}, None)],
    "tables": [(1, "d", "| a |\n|---|\n" + "| row |\n" * 9000), (2, "d", ""), (3, "d", "x" * 2000)],
    "images": [(1, "d", "x_제목.pdf", "page_scan", 1, LONG, None), (2, "d", "x", "page_scan", 2, None, ""), (3, "d", "x", "page_scan", 3, "\n\n-\n12", None)],
    "questions": [("Q1", "무엇인가?", {"agency": "시청(찬호로)"}), ("Q2", "", {})],
    "results": [(1, "무엇인가?", LONG, True), (2, "", "", False), (3, "무엇인가 그것은 무엇인가?", "무엇인가 그것은 무엇인가?", None)],
    "documents": [(1, LONG, "ko", "s"), (2, "", "", ""), (3, "꺼져라 멍청한 놈들아", "ko", "s")],
    "items": [(1, LONG[:300]), (2, ""), (3, "x")],
    "labels": [(3, "abusive", 1, None), (1, "clean", 1, None), (1, "abusive", 2, None)],
    "targets": [("s", 1.0, 2), ("t", 0.0, 1)],
}
RUNS = {
    "p1": (lambda t: split.found(t["chunks"], t["tables"]), ["item_kind", "item_id", "cut_kind"]),
    "p1_pieces": (lambda t: split.split_oversized(split.oversized(t["chunks"], t["tables"])), None),
    "p2": (lambda t: near_dup.found(t["chunks"]), ["chunk_id_a", "chunk_id_b"]),
    "p2_groups": (lambda t: near_dup.NearDuplicates(t["chunks"]).groups(), None),
    "p3": (lambda t: repetition.found(t["chunks"]), ["chunk_id"]),
    "p3_ablations": (lambda t: repetition.ablations(repetition.repetition_ledger(t["chunks"])), None),
    "p4": (lambda t: scans.found(t["images"]), ["field_name", "record_id", "line_no", "noise"]),
    "p5": (lambda t: lookalike.found(t["chunks"]), ["field_name", "id_a", "id_b"]),
    "p6": (lambda t: names.found(t["chunks"], t["questions"]), ["name_a", "name_b"]),
    "p7": (lambda t: qa_pairs.found(t["results"]), ["result_id", "defect"]),
    "p8": (lambda t: leakage.found(t["documents"], t["items"]), ["doc_id", "item_id"]),
    "p9": (lambda t: mixture.report(mixture.mix(t["documents"], t["targets"]), t["targets"]), None),
    "p10": (lambda t: toxicity.found(t["documents"], t["labels"]), ["doc_id", "category"]),
    "p10_rates": (lambda t: toxicity.rates(toxicity.scores(t["documents"], t["labels"])), None),
}
CLASHING = ["k", "n", "tid", "key", "a", "b", "t", "id", "value", "part", "word", "c", "x", "cell", "doc_key", "spike", "n_chars", "range", "page"]


def frame(spark, kind, rows):
    return spark.createDataFrame(rows, SCHEMAS[kind])


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, name):
    run, columns = RUNS[name]
    out = run({k: frame(spark, k, []) for k in SCHEMAS})
    assert columns is None or out.columns == columns
    assert name in ("p9", "p3_ablations") or out.count() == 0
    out.collect()


@pytest.mark.parametrize("name", RUNS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    run, columns = RUNS[name]
    plain = {k: frame(spark, k, v) for k, v in ROWS.items()}
    want = sorted(map(repr, run(plain).collect()))
    odd = {}
    for k, v in ROWS.items():
        width = len(v[0])
        nulls = [tuple(None for _ in range(width))]
        own = set(plain[k].columns)
        odd[k] = frame(spark, k, v + v[:1] + nulls + nulls)
        for c in CLASHING:
            if c not in own:
                odd[k] = odd[k].withColumn(c, F.lit("?"))
    out = run(odd)
    assert columns is None or out.columns == columns
    got = sorted(map(repr, out.collect()))
    if name not in ("p10_rates", "p9", "p3_ablations"):
        assert got == want
