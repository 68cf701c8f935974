"""What a document holds besides text, what to do about it, and texts read from its pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def reading_advice(n_pages, n_empty_pages) -> Column:
    """Whether pages must be read from their picture: required if none has text, a review if some lack it;
    not_checked for formats without pages."""
    p, e = F.col(n_pages), F.coalesce(F.col(n_empty_pages), F.lit(0))
    return F.when(p.isNull(), "not_checked").when((p > 0) & (e >= p), "ocr_required").when(e > 0, "review_required").otherwise("not_required")


def visual_advice(n_tables, n_images) -> Column:
    """Which reviews tables and images ask for."""
    t, i = F.coalesce(F.col(n_tables), F.lit(0)) > 0, F.coalesce(F.col(n_images), F.lit(0)) > 0
    return F.when(t & i, "table_and_image_review_required").when(i, "image_ocr_review_required").when(t, "table_extraction_review_required").otherwise("not_required")


def document_profile(documents: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_empty_pages, n_tables, n_images, reading, visual) of documents with page_count:
    scanned pages count as pages without text, other pictures as images; repeated records once."""
    t = tables.groupBy("doc_id").agg(F.count_distinct("record_id").alias("n_tables"))
    scan = F.col("source_type") == "page_scan"
    i = images.groupBy("doc_id").agg(F.count_distinct(F.when(scan, F.col("record_id"))).alias("n_empty_pages"), F.count_distinct(F.when(~scan, F.col("record_id"))).alias("n_images"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    d = documents.select("doc_id", F.col("page_count").alias("n_pages")).join(t, "doc_id", "left").join(i, "doc_id", "left").select("doc_id", "n_pages", zero("n_empty_pages"), zero("n_tables"), zero("n_images"))
    return d.select("*", reading_advice("n_pages", "n_empty_pages").alias("reading"), visual_advice("n_tables", "n_images").alias("visual"))


def read_texts(images: DataFrame) -> DataFrame:
    """(doc_id, texts): what was read from a document's pictures, in their order; blank texts and records
    that were not applied are left out. The result is one array per document by definition."""
    ok = images.where("vlm_status = 'applied' and trim(coalesce(ocr_text, '')) <> ''")
    one = F.struct("image_number", "record_id", F.regexp_replace("ocr_text", r"(?U)^\s+|\s+$", "").alias("t"))
    return ok.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]).alias("texts"))


def merge_read_texts(text, texts, mark: str = "[OCR image/table text]") -> Column:
    """A document's text followed by a marked list of what was read; without any, the stripped text."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    some = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.when(F.size(some) == 0, strip(text)).otherwise(strip(F.concat_ws("\n\n", strip(text), F.lit(mark), F.array_join(some, "\n\n"))))


def call_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Totals of a log of model calls (tokens_in, tokens_out, cost, seconds). A log is summed rather than an
    accumulator, which would count retried tasks twice."""
    sums = [F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cost", "seconds")]
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), *sums, F.avg("seconds").alias("mean_seconds"))
