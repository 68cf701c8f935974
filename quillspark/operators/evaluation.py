"""Evaluation of retrieval and answers: hits, keywords, summaries, comparisons, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import squeeze


def list_literal(c) -> Column:
    """The strings of a list literal like "['a', 'b']"; null gives null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(1))


def keyword_hits(keywords, answer) -> Column:
    """How many of the keywords the answer holds, as they are."""
    return F.size(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda x: F.contains(F.coalesce(answer, F.lit("")), x)))


def score_results(results: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per result: doc_hit (null without expected documents), doc_hit_count, keyword_hit,
    keyword_total, is_empty, hit_rate, success. Rows repeated with one id count once; results of unknown
    questions are left out."""
    r = results.dropDuplicates(["result_id"]).select("result_id", "question_id", "profile", "question_type", "final_answer", "response_seconds", list_literal("retrieved_doc_ids").alias("got"))
    q = questions.select("question_id", F.coalesce("expected_doc_ids", F.array().cast("array<string>")).alias("expected"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    j = r.join(q, "question_id")
    has = F.size("expected") > 0
    hits = keyword_hits(F.col("keywords"), F.col("final_answer"))
    got = F.coalesce("got", F.array().cast("array<string>"))
    out = j.select(
        "result_id", "question_id", "profile", "question_type", "response_seconds",
        F.when(has, F.arrays_overlap("expected", got)).alias("doc_hit"),
        F.when(has, F.size(F.filter(got, lambda x: F.array_contains("expected", x)))).alias("doc_hit_count"),
        hits.alias("keyword_hit"), F.size("keywords").alias("keyword_total"), (squeeze(F.coalesce("final_answer", F.lit(""))) == "").alias("is_empty"),
    )
    total = F.col("keyword_total")
    return out.withColumn("hit_rate", F.when(total > 0, F.col("keyword_hit") / total)).withColumn("success", F.col("keyword_hit") == total)


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Counts, sums and means of scored results by the given columns (none: one row), rounded to 4 digits."""
    r = lambda c: F.round(c, 4)
    aggs = [
        F.count("*").alias("n_results"), F.count("doc_hit").alias("n_expected"), F.count_if("doc_hit").alias("n_doc_hit"), F.sum("keyword_hit").alias("keyword_hit"), F.sum("keyword_total").alias("keyword_total"),
        F.count_if("is_empty").alias("n_empty"), r(F.avg("response_seconds")).alias("mean_seconds"), r(F.avg("hit_rate")).alias("macro_hit_rate"), r(F.avg(F.col("success").cast("int"))).alias("success_rate"),
    ]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def trials(scored: DataFrame) -> DataFrame:
    """(profile, question_id, n_trials, mean_hit_rate, success_rate, first_seconds): repeated trials averaged,
    the first by result id."""
    return scored.groupBy("profile", "question_id").agg(F.count("*").alias("n_trials"), F.round(F.avg("hit_rate"), 4).alias("mean_hit_rate"), F.round(F.avg(F.col("success").cast("int")), 4).alias("success_rate"), F.min_by("response_seconds", "result_id").alias("first_seconds"))


def deltas(df: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    """df with `delta`, the difference of a value to the step before within the groups."""
    return df.withColumn("delta", F.round(F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(order)), 6))


def ceiling_rate(df: DataFrame, value: str, ceiling: float, *by: str) -> DataFrame:
    """How often a value reaches its ceiling."""
    hit = F.col(value) >= ceiling
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_at_ceiling"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))


def extrapolated(df: DataFrame, value: str, to: int, *by: str) -> DataFrame:
    """The sum of a value carried on from the rows there are to a number of rows."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.sum(value) / F.count(value) * to, 6).alias("extrapolated"))


def history(turns: DataFrame, max_turns: int = 3) -> DataFrame:
    """turns (conversation_id, turn_no, question_id, question, answer) with `history`, the last max_turns
    turns before each as array<struct<question,answer>>, the oldest first; [] for the first and for 0."""
    w = W.partitionBy("conversation_id").orderBy("turn_no", "question_id")
    empty = F.array().cast("array<struct<question:string,answer:string>>")
    if max_turns <= 0:
        return turns.withColumn("history", empty)
    return turns.withColumn("history", F.coalesce(F.collect_list(F.struct("question", "answer")).over(w.rowsBetween(-max_turns, -1)), empty))


def pair_messages(messages: DataFrame) -> DataFrame:
    """(conversation_id, turn_no, question, answer) from alternating messages (conversation_id, n, role, text);
    a user's message followed by no answer of the assistant is no turn, other roles are dropped."""
    w = W.partitionBy("conversation_id").orderBy("n")
    m = messages.where("role in ('user', 'assistant')").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    m = m.where("role = 'user' and next_role = 'assistant'")
    return m.select("conversation_id", F.row_number().over(w).alias("turn_no"), F.col("text").alias("question"), "answer")


# The questions that a new index is tried with.
SMOKE_QUESTIONS = (
    "AI 학습지원 플랫폼의 주요 기능 요구사항을 알려줘",
    "사업 예산과 수행 기간은 어떻게 돼?",
    "제안서는 언제까지 어떤 방식으로 제출해야 해?",
    "문서에 블록체인 기능 요구사항이 있어?",
)


def smoke_questions(spark: SparkSession) -> DataFrame:
    """(query_id, query) of SMOKE_QUESTIONS."""
    return spark.createDataFrame([(f"smoke_{i}", q) for i, q in enumerate(SMOKE_QUESTIONS, 1)], "query_id string, query string")


def lookup_question(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (ask_id, question) with the known question_id of equal text, white space aside; the least of several."""
    k = known.groupBy(squeeze("question").alias("k")).agg(F.min("question_id").alias("question_id"))
    return asked.withColumn("k", squeeze("question")).join(k, "k", "left").drop("k")
