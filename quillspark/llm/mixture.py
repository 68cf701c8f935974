"""Problem 9: mixing sources to target weights.

Method: every document gets a hash-random key; within each source the documents are put in the
order of the keys by ranges of the key, token counts are summed per range, the prefix sums of the
ranges carry on into the ranges, and the order is cut at the exact budget of the source. Sources
whose budget exceeds their tokens are repeated in whole epochs first, at most max_repeats times.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize

#: Documents in one range of the key, on average: the most that one window orders.
RANGE_ROWS = 50_000
_ENCODERS: dict[str, object] = {}


def default_tokenizer() -> str:
    """The path of the public tokenizer's ranks that is used where none is named."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoder(path: str):
    """A tiktoken encoding from a file of ranks, kept per worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with an id; a null text has 0 tokens."""
    path = tokenizer or default_tokenizer()

    def run(it):
        enc = encoder(path)
        for batch in it:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    src = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return src.mapInArrow(run, "doc_id long, source string, n_tokens long")


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], size: int | None = None) -> dict[str, tuple[int, int]]:
    """source -> (whole epochs, tokens of the last part). Without a size, the largest mixture that
    meets every share that can be met: a source without any tokens gives nothing and does not bound the
    others. With a size, sources short of tokens give all they may."""
    live = [(s, w, r) for s, w, r in targets if w and w > 0 and r and r > 0]
    if size is None:
        size = int(min((totals[s] * r / w for s, w, r in live if totals.get(s)), default=0))
    out = {}
    for s, w, r in live:
        n = totals.get(s, 0)
        budget = min(int(round(w * size)), n * r)
        out[s] = (budget // n, budget % n) if n else (0, 0)
    return out


def mix(documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 7, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, epoch): the rows of the mixture; a document of a repeated source
    comes once per epoch.

    Documents without a source or of a source without target don't take part. A repeated document
    row counts once. The last part of a source ends with the last document that still fits. The
    table of targets is one row per source and is read on the driver.
    """
    goals = [(r.source, r.target_share, r.max_repeats) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").collect()]
    counts = materialize(token_counts(documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), tokenizer).dropDuplicates(["doc_id"]), "tokens")
    stats = {r.source: (r.n, r.t) for r in counts.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    parts = plan({s: t for s, (_, t) in stats.items()}, goals, size)
    spark = documents.sparkSession
    rows = [(s, e, last, max(1, -(-stats.get(s, (0, 0))[0] // RANGE_ROWS))) for s, (e, last) in parts.items()]
    cut = spark.createDataFrame(rows, "source string, epochs int, last long, ranges int")
    keyed = counts.join(F.broadcast(cut), "source").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    # equal ranges of the upper 32 bits of the key, which is uniform
    keyed = keyed.withColumn("range", (F.shiftrightunsigned("key", 32) * F.col("ranges") / F.lit(1 << 32)).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("source", "range", F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    placed = keyed.withColumn("inside", inside).join(before, ["source", "range"])
    times = F.col("epochs") + F.when(F.col("before") + F.col("inside") <= F.col("last"), 1).otherwise(0)
    return placed.withColumn("times", times).where("times > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"))


def report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_rows, n_tokens, epochs) of every target source."""
    got = mixture.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.max("epoch").alias("epochs"))
    all_of = got.agg(F.sum("n_tokens").alias("total"))
    out = targets.select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(all_of))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.col("total")).alias("actual_share"), zero("n_rows"), zero("n_tokens"), zero("epochs"))


def checks(mixture: DataFrame, targets: DataFrame, documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(source, share_met, repeats_met) of every target source: whether its tokens are its share of all, but for
    the one document at its cut that doesn't fit any more, which its largest one bounds, and whether no document
    comes oftener than max_repeats allows, or twice in an epoch."""
    largest = token_counts(documents.where("source is not null"), tokenizer).groupBy("source").agg(F.max("n_tokens").alias("most"))
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("epochs"))
    rows = mixture.groupBy("source", "doc_id", "epoch").agg(F.count("*").alias("k")).groupBy("source").agg(F.max("k").alias("k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    x = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").join(rows, "source", "left").join(largest, "source", "left")
    total = x.agg(F.sum(zero("n")).alias("total"), F.sum(zero("most")).alias("cuts"))
    near = F.abs(zero("n") - F.col("target_share") * F.col("total")) <= zero("most") + F.col("target_share") * F.col("cuts") + 1
    return x.crossJoin(F.broadcast(total)).select("source", near.alias("share_met"), ((zero("epochs") <= F.col("max_repeats")) & (zero("k") <= 1)).alias("repeats_met"))  # one row
