"""Chunks of bodies, sections, tables and images, and the contract that chunks keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.tables import image_headline
from ..functions.text import _col, split_lines, squeeze, windows
from ..session import materialize

CHUNK_SIZE, CHUNK_OVERLAP, TABLE_SIZE, IMAGE_SIZE = 800, 120, 800, 800
REQUIRED = ("chunk_id", "doc_id", "text")
REQUIRED_METADATA = ("title", "project_name", "agency", "file_name")


def number_parts(df: DataFrame, key: str, order: list[str], pattern: str, out: str = "chunk_id") -> DataFrame:
    """df with ids like doc_chunk_0001: numbers run on within each key in the given order, which must tell
    the rows of a key apart.

    The rows are put into ranges of key and order, numbered inside the ranges, and carried on by the
    ranges' sizes, so that a key with a large share of all rows is not numbered by one task.
    """
    r = materialize(df.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = r.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__at")).agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(W.partitionBy("__key").orderBy("__at").rowsBetween(W.unboundedPreceding, -1))  # a row per range that a key touches
    before = sizes.select("__key", "__at", F.coalesce(earlier, F.lit(0)).alias("__before"))
    inside = r.withColumn("__i", F.row_number().over(W.partitionBy(key, "__range").orderBy(*order)))
    n = inside.join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at"))).withColumn("part_no", F.col("__before") + F.col("__i"))
    return n.withColumn(out, F.format_string(f"%s{pattern}%04d", F.col(key), F.col("part_no"))).drop("__key", "__at", "__before", "__i", "__range")


def body_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_id, part_no, text) windows of whole texts. Null and blank texts have no chunk. The
    windows of a text are numbered inside its row, without a shuffle: keys must be unique."""
    s = docs.select(F.col(key), squeeze(text).alias("__s"))
    parts = s.select(F.col(key), F.explode(windows("__s", size, overlap, squeezed=True)).alias("w"))
    return parts.select(key, F.format_string("%s_chunk_%04d", F.col(key).cast("string"), F.col("w.part")).alias("chunk_id"), F.col("w.part").alias("part_no"), F.col("w.text").alias("text"))


def section_chunks(docs: DataFrame, key: str = "doc_id", sections: str = "sections", text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of array<struct<title,text>> with the section's title as first line and column; numbers run
    on over the sections. Documents without sections are cut as a whole."""
    kind = "array<struct<title:string,text:string>>"
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col(text).alias("text")))
    given = F.coalesce(F.col(sections), F.array().cast(kind))
    tidy = F.transform(F.when(F.size(given) > 0, given).otherwise(whole), lambda x: F.struct(F.nullif(x["title"], F.lit("")).alias("title"), squeeze(x["text"]).alias("text")))
    docs = docs.select(key, tidy.alias("__s"))
    cut = F.flatten(F.transform("__s", lambda x: F.transform(windows(x["text"], size, overlap, squeezed=True), lambda w: F.struct(x["title"].alias("section_title"), w["text"].alias("text")))))
    p = docs.select(key, F.posexplode(cut).alias("i", "c"))
    body = F.when(F.col("c.section_title").isNotNull(), F.concat(F.lit("["), F.col("c.section_title"), F.lit("]\n"), F.col("c.text"))).otherwise(F.col("c.text"))
    return p.select(key, F.format_string("%s_chunk_%04d", F.col(key), F.col("i") + 1).alias("chunk_id"), "c.section_title", body.alias("text"))


def _packed(lines: Column, first: Column, most: int) -> Column:
    """Lines packed into parts of at most `most` characters, in one fold; every part opens with `first`
    where that isn't null, and a line too long for any part stands alone after it."""
    base = F.coalesce(F.length(first), F.lit(-1))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), base.alias("n"))

    def step(acc, x):
        full = (F.size(acc["now"]) > 0) & (acc["n"] + F.length(x) + 1 > most)
        return F.when(full, F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), F.array(x).alias("now"), (base + F.length(x) + 1).alias("n"))).otherwise(
            F.struct(acc["done"].alias("done"), F.array_append(acc["now"], x).alias("now"), (acc["n"] + F.length(x) + 1).alias("n"))
        )

    def finish(acc):
        all_of = F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        return F.transform(all_of, lambda p: F.array_join(F.when(first.isNotNull(), F.concat(F.array(first), p)).otherwise(p), "\n"))

    return F.aggregate(lines, start, step, finish)


def table_parts(markdown, most: int = TABLE_SIZE) -> Column:
    """A table cut between rows, the first line repeated on every part. A table within the limit comes
    back as it is; a row too long for it isn't cut; a header alone beyond it gives nothing."""
    m = _col(markdown)
    rows = F.filter(split_lines(m), lambda x: F.trim(x) != "")
    cut = _packed(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.get(rows, F.lit(0)), most)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, F.array().cast("array<string>")).when(F.length(m) <= most, F.array(m)).otherwise(cut)


def line_parts(text, most: int = IMAGE_SIZE) -> Column:
    """A stripped text cut between lines; each line counts one more for its end."""
    t = F.regexp_replace(_col(text), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(_packed_lines(split_lines(t), most))


def _packed_lines(lines: Column, most: int) -> Column:
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(acc, x):
        full = (F.size(acc["now"]) > 0) & (acc["n"] + F.length(x) + 1 > most)
        return F.when(full, F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), F.array(x).alias("now"), (F.length(x) + 1).alias("n"))).otherwise(
            F.struct(acc["done"].alias("done"), F.array_append(acc["now"], x).alias("now"), (acc["n"] + F.length(x) + 1).alias("n"))
        )

    return F.aggregate(lines, start, step, lambda acc: F.transform(F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]), lambda p: F.array_join(p, "\n")))


def headline(agency, title) -> Column:
    """'[agency · title]' and a line end; without either, nothing."""
    s = F.concat_ws(" · ", F.nullif(_col(agency), F.lit("")), F.nullif(_col(title), F.lit("")))
    return F.when(s == "", "").otherwise(F.concat(F.lit("["), s, F.lit("]\n")))


def table_chunks(tables: DataFrame, most: int = TABLE_SIZE, with_headline: Column | None = None) -> DataFrame:
    """Chunks of table records with provenance; numbers run on within a document by table and record."""
    parts = tables.where("table_markdown is not null").select("doc_id", "record_id", "page_number", "table_number", "extraction_method", F.posexplode(table_parts("table_markdown", most)).alias("i", "part"))
    text = F.col("part") if with_headline is None else F.concat(with_headline, F.col("part"))
    out = number_parts(parts, "doc_id", ["table_number", "record_id", "i"], "_table_")
    return out.select("chunk_id", "doc_id", text.alias("text"), F.lit("table").alias("chunk_source"), "extraction_method", "page_number", "table_number", "record_id")


def image_chunks(images: DataFrame, most: int = IMAGE_SIZE) -> DataFrame:
    """Chunks of image records: a headline with type and summary, then the combined context, or what was
    read where that is missing."""
    text = F.concat(image_headline("image_type", "vlm_text"), F.coalesce(F.nullif(F.col("combined_context"), F.lit("")), F.col("ocr_text"), F.lit("")))
    parts = images.select("doc_id", "record_id", "image_number", "page_number", "image_type", "ocr_engine", F.posexplode(line_parts(text, most)).alias("i", "part"))
    out = number_parts(parts, "doc_id", ["image_number", "record_id", "i"], "_img_")
    return out.select("chunk_id", "doc_id", F.col("part").alias("text"), F.lit("image").alias("chunk_source"), F.coalesce("image_type", F.lit("unclassified")).alias("image_type"), F.coalesce("ocr_engine", F.lit("")).alias("ocr_engine"), "page_number", "image_number")


def contract_violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, reason) of chunks that break the contract, with the first reason: a missing field, missing
    metadata, a missing or blank metadata field, a blank text."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    why = F.coalesce(
        *[F.when(F.col(c).isNull(), f"missing {c}") for c in REQUIRED],
        F.when(F.col("metadata").isNull(), "missing metadata"),
        *[F.when(blank(F.col("metadata")[k]), f"missing metadata.{k}") for k in REQUIRED_METADATA],
        F.when(blank(F.col("text")), "blank text"),
    )
    return chunks.select("chunk_id", why.alias("reason")).where("reason is not null")


def require(violations: DataFrame) -> None:
    """Raise with one example if there is any violation."""
    first = violations.head(1)
    if first:
        raise ValueError(f"contract broken: {first[0].asDict()}")
