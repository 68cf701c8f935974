"""Problem 3: repetition inside a single document.

Method: a rule bitmask ledger. Each rule is measured once per document and leaves its measurement
and, if it fails, one bit. Policies are versioned masks over these bits; they and their ablations
are then plain bitwise aggregations over the ledger, without a second look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fold import batches_by_size, code_points, fold, gram_hashes, mix, unify

#: Characters of a stretch that count as repeated when they occurred before.
STRETCH = 12


@dataclass(frozen=True)
class Rule:
    """A measurement that fails at or above a threshold; its place in RULES is its bit."""

    name: str
    threshold: float


RULES = (
    Rule("stretch_share", 0.30),  # characters in stretches of 12 or more that occurred before
    Rule("line_share", 0.30),  # characters in lines that occurred before
    Rule("sentence_share", 0.30),  # characters in sentences that occurred before
    Rule("word_run_share", 0.20),  # words equal to the word before
    Rule("char_run_share", 0.20),  # characters in runs of one character, 5 or more
)
#: Policy name and version -> mask over the bits of RULES.
POLICIES = {"found_v1": 0b00001, "strict_v1": 0b11111, "lines_v1": 0b00110}


def stretch_share(texts: list[str], k: int = STRETCH) -> np.ndarray:
    """Of each text, reduced to letters and digits, the share of characters in repeated stretches."""
    cp, lens = code_points(texts, alnum=True)
    h, doc, pos = gram_hashes(cp, lens, k)
    share = np.zeros(len(texts))
    if len(h) == 0:
        return share
    key = h ^ mix(doc.astype(np.uint64) + np.uint64(1))
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice) == 0:
        return share
    mark = np.zeros(1 << 20, bool)
    mark[twice & np.uint64(mark.size - 1)] = True
    some = np.flatnonzero(mark[key & np.uint64(mark.size - 1)])
    at = np.minimum(np.searchsorted(twice, key[some]), len(twice) - 1)
    some = some[twice[at] == key[some]]  # in order of position, so that the first of a key is the earliest
    _, first = np.unique(key[some], return_index=True)
    later = np.ones(len(some), bool)
    later[first] = False
    hit = some[later]
    starts = np.cumsum(lens) - lens
    flat = starts[doc[hit]] + pos[hit]
    cover = np.zeros(len(cp) + 1, np.int32)
    np.add.at(cover, flat, 1)
    np.add.at(cover, flat + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    n = covered[starts + lens] - covered[starts]
    return np.divide(n, lens, out=share, where=lens > 0)


def _again(parts: list[str]) -> float:
    seen: set[str] = set()
    total = twice = 0
    for p in parts:
        p = p.strip()
        if p:
            total += len(p)
            if p in seen:
                twice += len(p)
            seen.add(p)
    return twice / total if total else 0.0


def _run_shares(texts: list[str], least: int = 5) -> np.ndarray:
    """Of each text, the share of characters in runs of one character, `least` or more."""
    cp, lens = code_points(texts)
    if len(cp) == 0:
        return np.zeros(len(texts))
    stops = np.cumsum(lens)
    new = np.concatenate([[True], cp[1:] != cp[:-1]])
    new[(stops - lens)[(lens > 0)]] = True
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(cp)))
    long = n >= least
    total = np.zeros(len(cp) + 1, np.int64)
    total[at[long] + 1] = n[long]
    total = np.cumsum(total)
    return np.divide(total[stops] - total[stops - lens], lens, out=np.zeros(len(texts)), where=lens > 0)


def measure(texts: list[str]) -> np.ndarray:
    """A row per text with the measurements of RULES, in their order."""
    folded = [fold(s) for s in texts]
    out = np.zeros((len(texts), len(RULES)))
    out[:, 0] = stretch_share(folded)
    out[:, 4] = _run_shares(folded)
    for i, (raw, f) in enumerate(zip(texts, folded)):
        words = f.split(" ")
        if "\n" in raw:
            out[i, 1] = _again(unify(raw).lower().split("\n"))
        if ". " in f or "! " in f or "? " in f:
            out[i, 2] = _again(f.replace("! ", ". ").replace("? ", ". ").split(". "))
        out[i, 3] = sum(map(eq, words, words[1:])) / len(words)
    return out


def repetition_ledger(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, a column per rule's measurement, bits (long).

    Rows repeated with the same id count once. Null texts have no row; an empty text, or one
    without letters and digits, measures 0 and fails no rule. Other columns are ignored.
    """
    rules = RULES

    def run(it):
        for batch in it:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches_by_size(texts):
                m = measure(texts[a:b])
                bits = sum(((m[:, i] >= r.threshold).astype(np.int64) << i) for i, r in enumerate(rules))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), *[pa.array(m[:, i]) for i in range(len(rules))], pa.array(bits, pa.int64())],
                    names=["doc_key", "n_chars", *[r.name for r in rules], "bits"],
                )

    src = chunks.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_key"), F.col(text_col).alias("t"))
    measured = src.mapInArrow(run, f"doc_key string, n_chars long, {', '.join(f'{r.name} double' for r in rules)}, bits long")
    return measured.dropDuplicates(["doc_key"]).withColumnRenamed("doc_key", id_col)


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger's rows that fail the policy."""
    return ledger.where(F.col("bits").bitwiseAND(F.lit(POLICIES[policy])) != 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and rule in it: documents that fail the policy, and still without the rule."""
    cases = [(p, m, r.name, m & ~(1 << i)) for p, m in POLICIES.items() for i, r in enumerate(RULES) if m >> i & 1]
    # the ledger is first reduced to one row per bit pattern, at most 2^rules rows
    patterns = ledger.groupBy("bits").agg(F.count("*").alias("n"))
    case = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).alias("mask"), F.lit(r).alias("rule"), F.lit(w).alias("without")) for p, m, r, w in cases])).alias("c")
    fails = lambda m: F.sum(F.when(F.col("bits").bitwiseAND(F.col(m).cast("long")) != 0, F.col("n")).otherwise(0))
    return patterns.select("bits", "n", case).select("bits", "n", "c.*").groupBy("policy", "rule").agg(F.sum("n").alias("n_docs"), fails("mask").alias("n_failed"), fails("without").alias("n_failed_without"))


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that fail the policy found_v1."""
    return apply_policy(repetition_ledger(chunks), "found_v1").select("chunk_id")
