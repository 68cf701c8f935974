"""Metadata of documents: standard form, joins with guards, audits and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TEXT_FIELDS = ("project_name", "title", "agency", "notice_number", "notice_round", "budget", "summary")


def clean_value(c) -> Column:
    """Stripped; null becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def file_kind(file_type, file_name) -> Column:
    """The file type in lower case without dot; where it is blank, the suffix of the file's name."""
    given = F.regexp_replace(F.lower(clean_value(file_type)), r"^\.+", "")
    suffix = F.lower(F.regexp_extract(clean_value(file_name), r"[^./\\]\.([^./\\]+)$", 1))
    return F.when(given != "", given).otherwise(suffix)


def standard(source: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Source rows in standard form: no nulls in text fields, file type by name where blank, and whether the
    file exists, by the listing (path) where one is given."""
    s = source.select("doc_id", clean_value("file_name").alias("file_name"), *[clean_value(c).alias(c) for c in TEXT_FIELDS], file_kind("file_type", "file_name").alias("file_type"), clean_value("source_path").alias("source_path"), F.coalesce("source_exists", F.lit(False)).alias("source_exists"))
    if listing is None:
        return s
    known = listing.select(F.col("path").alias("source_path"), F.lit(True).alias("there")).distinct()
    return s.drop("source_exists").join(known, "source_path", "left").withColumn("source_exists", F.coalesce("there", F.lit(False))).drop("there")


def required_problems(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: n_rows, blank counts of required fields, duplicated keys, missing files."""
    blank = [F.count_if(F.coalesce(F.trim(F.col(c)) == "", F.lit(True))).alias(f"blank_{c}") for c in required]
    return rows.agg(F.count("*").alias("n_rows"), *blank, (F.count("doc_id") - F.count_distinct("doc_id")).alias("duplicated_doc_id"), F.count_if(~F.coalesce("source_exists", F.lit(False))).alias("missing_sources"))


def null_profile(df: DataFrame) -> DataFrame:
    """(field, n_null, n_blank) of every column, in one pass over the rows."""
    text = {n for n, t in df.dtypes if t == "string"}
    parts = [F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull()).alias("n_null"), (F.count_if(F.trim(F.col(c)) == "") if c in text else F.lit(0).cast("long")).alias("n_blank")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once. The keys are counted first and joined back, so that no
    window gathers a group."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n_same")).where("n_same > 1")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return df.alias("l").join(twice.alias("r"), same).select("l.*", "r.n_same")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of either side that the other lacks."""
    a = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    return a.union(right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right")))


# Columns of the metadata table and the keys that chunks have them under.
CHUNK_KEYS = (("title", "title"), ("title", "project_name"), ("agency", "agency"), ("file_name", "file_name"), ("document_type", "document_type"), ("notice_number", "notice_number"), ("summary", "summary"))


def chunk_metadata(keys: tuple[tuple[str, str], ...] = CHUNK_KEYS) -> Column:
    """A map of columns under their keys, from (column, key) in that order; nulls are omitted."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for c, k in keys]), lambda x: x["value"].isNotNull())
    return F.map_from_entries(pairs)


def merge_metadata(chunks: DataFrame, meta: DataFrame, fields: tuple[str, ...], strict: bool = True) -> DataFrame:
    """Chunks with their metadata map overwritten by the fields of their document. Null fields are omitted
    and keep what the chunk has. With strict, a chunk without document raises before anything is returned."""
    if strict:
        lost = chunks.join(meta.select("doc_id").distinct(), "doc_id", "left_anti").head(1)
        if lost:
            raise ValueError(f"chunk without metadata: {lost[0]['doc_id']}")
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields]), lambda x: x["value"].isNotNull())
    m = meta.select("doc_id", pairs.alias("__new"))
    old = F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    kept = F.filter(old, lambda x: ~F.exists("__new", lambda y: y["key"] == x["key"]))
    return chunks.join(m, "doc_id").withColumn("metadata", F.map_from_entries(F.concat(kept, F.col("__new")))).drop("__new")


def first_difference(chunks: DataFrame, meta: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(chunk_id, doc_id, field, in_chunk, in_document) of the first field in which a chunk's metadata differ."""
    j = chunks.select("chunk_id", "doc_id", "metadata").join(meta.select("doc_id", *fields), "doc_id")
    bad = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col("metadata")[f].alias("in_chunk"), F.col(f).cast("string").alias("in_document")) for f in fields]), lambda x: ~x["in_chunk"].eqNullSafe(x["in_document"]))
    return j.select("chunk_id", "doc_id", F.get(bad, F.lit(0)).alias("d")).where("d is not null").select("chunk_id", "doc_id", "d.*")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `status`: 'ok' for the first row of each key in the order, 'duplicate' for the later ones. The
    order must tell the rows of a key apart; rows alike in it are all 'ok'. The first rows are found by a
    grouped minimum, so that no task sorts a whole group."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    at = F.struct(*[F.col(f"l.{o}") for o in order])
    return df.alias("l").join(first.alias("r"), same).select("l.*", F.when(at.eqNullSafe(F.col("r.__first")), "ok").otherwise("duplicate").alias("status"))


def budget_amount(c) -> Column:
    """A typed budget as a number: its digits, or millions and hundred-millions where the unit says so."""
    s = F.regexp_replace(clean_value(c), r"[,\s]", "")
    n = lambda p: F.regexp_extract(s, p, 1).try_cast("decimal(20,4)")
    return F.coalesce(n(r"([0-9]+(?:\.[0-9]+)?)억") * 100_000_000, n(r"([0-9]+(?:\.[0-9]+)?)백만") * 1_000_000, n(r"([0-9]+(?:\.[0-9]+)?)천원") * 1_000, n(r"([0-9]+(?:\.[0-9]+)?)")).cast("decimal(20,0)")
