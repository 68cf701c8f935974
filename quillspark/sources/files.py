"""Reading and writing: chunk lines, CSV tables, whole texts, file listings, and the record forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
SECTION = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
CLEAN_DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("sections", T.ArrayType(SECTION)), T.StructField("text_sha256", T.StringType())])
QUESTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question_id", "type", "question")]
    + [T.StructField("expected_doc_ids", T.ArrayType(T.StringType())), T.StructField("reference_answer", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("calculation", T.StringType())]
    + [T.StructField("filters", T.MapType(T.StringType(), T.StringType())), T.StructField("conversation_id", T.StringType()), T.StructField("turn", T.IntegerType()), T.StructField("note", T.StringType())]
)
RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("question_id", "type", "profile", "question", "retrieved_doc_ids")]
    + [T.StructField("doc_hit", T.BooleanType()), T.StructField("keyword_hit", T.IntegerType()), T.StructField("keyword_total", T.IntegerType()), T.StructField("is_empty", T.BooleanType()), T.StructField("final_answer", T.StringType()), T.StructField("response_seconds", T.DoubleType())]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str, schema: T.StructType = CHUNK, validate=None) -> DataFrame:
    """JSON lines in a fixed form; blank lines are skipped, a missing file is an empty table. `validate`
    (DataFrame -> violations) raises if it finds any. A number in a map comes as its text."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path).where(F.trim("value") != "")
    df = raw.select(F.from_json("value", schema).alias("r")).select("r.*")
    if validate is not None and (bad := validate(df).head(1)):
        raise ValueError(f"contract broken: {bad[0].asDict()}")
    return df


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key, the one of the greatest order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def read_table(spark: SparkSession, path: str, schema: T.StructType | list[str]) -> DataFrame:
    """A CSV file with header, quoted line ends and perhaps a byte order mark, in a fixed form (names alone
    mean strings). Columns are taken by name; a missing one raises."""
    names = schema if isinstance(schema, list) else schema.names
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', inferSchema=False, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip('"') for c in raw.columns])
    if lost := [n for n in names if n not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    if isinstance(schema, list):
        return raw.select(*names)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def number_rows(df: DataFrame, column: str = "row_no") -> DataFrame:
    """df with the rows numbered from 1 in the order of the file. Meant for the small metadata tables whose
    position is a key; the numbering reads the table twice."""
    names = df.columns
    kinds = df.schema
    out = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return df.sparkSession.createDataFrame(out, T.StructType([*kinds.fields, T.StructField(column, T.LongType())])).select(column, *names)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, without byte order mark, stripped."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("v"))
    return raw.select("path", F.regexp_replace(F.regexp_replace("v", "^﻿", ""), r"(?U)^\s+|\s+$", "").alias("text"))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length, suffix) of all files below root with one of the suffixes; their bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    s = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("suffix", s).where(F.col("suffix").isin(*[x.lower().lstrip(".") for x in suffixes]))


def read_bytes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of binary files, for the parsers of documents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; other alphabets stay as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_report(df: DataFrame, path: str, columns: list[str], mark: bool = True) -> None:
    """A CSV report with the given columns in their order; with `mark`, the first header carries a byte
    order mark for spreadsheets."""
    out = df.select(*[F.col(c).alias(("﻿" if mark and i == 0 else "") + c) for i, c in enumerate(columns)])
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def demo_chunks(spark: SparkSession) -> DataFrame:
    """Two chunks that keep the contract, for use where no file is at hand."""
    m = {"title": "표본 사업", "project_name": "표본 사업", "agency": "표본시청", "file_name": "sample.txt"}
    return spark.createDataFrame([("demo_chunk_0001", "demo", "사업 기간은 계약일부터 6개월이다.", m), ("demo_chunk_0002", "demo", "제안서는 전자 입찰로 낸다.", m)], CHUNK)
