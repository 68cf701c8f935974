"""Problem 8: evaluation texts leaking into training text.

Method: Aho-Corasick automata over the normalised evaluation items. Their patterns are the distinct
12-character substrings of the items, so that one scan of a passage counts, for every item at once, how
many of its substrings the passage holds; partial leaks are found like full ones. The offsets of the
matches are mapped back to the original text.

The corpus is read once, whatever the number of items. An automaton over any number of items has no size
bound, but a table of CELLS bytes has, and nothing else goes to every worker: for the hash of each
substring of an item it names the item's group, one of GROUPS, or that several groups share it. In that
one reading, documents that cannot hold half of any item by the counts of their groups are left out, and
each of the others gives the passages whose substrings are all in the table. Items are dealt to blocks of
about BLOCK_CHARS characters with an automaton each; an equality join of hashes tells which blocks a
document has to meet, and a block's documents are dealt to slices of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .fold import ALNUM, batches_by_size, mix

K, SHARE, BLOCK_CHARS, SLICE_CHARS, CELLS, GROUPS, SHARED = 12, 0.5, 1_000_000, 1_000_000, 1 << 24, 254, 255
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 2**i, 1 << 64)) for i in range(3)]
_LEAKS = "doc_id long, item_id long, n_shared int, n_item int, start_at int, end_at int"


def normalize(text: str) -> str:
    """Lower-case letters and digits."""
    return "".join(filter(str.isalnum, text.lower()))


def offsets(text: str) -> np.ndarray:
    """For each character of normalize(text), the place in text that it comes from."""
    low = text.lower()
    if len(low) == len(text):
        return np.flatnonzero(ALNUM[_code_points(low)])
    lens = np.fromiter((len(c.lower()) for c in text), np.int64, len(text))
    place = np.repeat(np.arange(len(text)), lens)
    return place[ALNUM[_code_points("".join(c.lower() for c in text))]]


def _code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends): hashes of the K (= 12) characters from each place of all normalised texts in a row,
    and the range of places of each text; hashes that reach into the next text stand outside the ranges."""
    low = [t.lower() for t in texts]
    cp = _code_points("".join(low))
    keep = ALNUM[cp]
    stop = np.concatenate([[0], np.cumsum(keep)])[np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))]
    start = np.concatenate([[0], stop[:-1]])
    c = cp[keep].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in (1, 2, 4):
            four = c
            if len(c) <= k:
                return np.empty(0, np.uint64), start, start
            c = c[:-k] * _POWERS[k.bit_length() - 1] + c[k:]
        if len(c) <= 4:
            return np.empty(0, np.uint64), start, start
        h = c[:-4] * _POWERS[2] + four[8:]
    return h, start, np.maximum(start, stop - K + 1)


def cell(h: np.ndarray) -> np.ndarray:
    """The place of a hash in the table."""
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(40)).astype(np.int64)  # 24 bits: CELLS


class Items:
    """Evaluation items with an automaton over their substrings."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        number: dict[str, int] = {}
        owner, gram = [], []
        self.ids = [i for i, _ in items]
        for n, (_, text) in enumerate(items):
            t = normalize(text)
            own = {t[i : i + K] for i in range(len(t) - K + 1)}
            gram += [number.setdefault(g, len(number)) for g in own]
            owner += [n] * len(own)
        order = np.argsort(np.array(gram, np.int64), kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.size = np.bincount(self.owner, minlength=len(items)) if owner else np.zeros(len(items), np.int64)
        self.first = np.searchsorted(np.array(gram, np.int64)[order], np.arange(len(number) + 1))
        self.least = max(1, int(np.ceil(SHARE * min(self.size[self.size > 0], default=1))))
        self.automaton = ahocorasick.Automaton()
        for g, n in number.items():
            self.automaton.add_word(g, n)
        self.empty = not number
        if number:
            self.automaton.make_automaton()

    def owners(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, index into grams) of every item that a gram belongs to."""
        n = self.first[grams + 1] - self.first[grams]
        which = np.repeat(np.arange(len(grams)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[grams], n)
        return self.owner[at], which

    def scan(self, passages: list[tuple[int, str]]) -> list[tuple[int, int, int, int, int]]:
        """(item id, substrings shared, substrings of the item, start, end in the text) of each item that the
        passages (start in the text, passage) of one document hold."""
        if self.empty:
            return []
        starts, ends, grams = [], [], []
        for at, p in passages:
            hits = list(self.automaton.iter(normalize(p)))
            if hits:
                e, g = np.array(hits, np.int64).T
                place = offsets(p) + at
                starts.append(place[e - K + 1])
                ends.append(place[e] + 1)
                grams.append(g)
        if not grams:
            return []
        starts, ends, grams = map(np.concatenate, (starts, ends, grams))
        seen = np.unique(grams)
        if len(seen) < self.least:
            return []
        shared = np.bincount(self.owners(seen)[0], minlength=len(self.ids))
        held = np.flatnonzero((shared >= SHARE * self.size) & (self.size > 0))
        if len(held) == 0:
            return []
        who, which = self.owners(grams)
        return [(self.ids[i], int(shared[i]), int(self.size[i]), int(starts[which[who == i]].min()), int(ends[which[who == i]].max())) for i in held]


def item_hashes(items: DataFrame) -> DataFrame:
    """(item, block, hash, cell) of the distinct substrings of (item, block, text)."""

    def run(it):
        for batch in it:
            texts = batch.column(2).to_pylist()
            for lo, hi in batches_by_size(texts):
                h, start, end = hashes(texts[lo:hi])
                at = np.repeat(np.arange(hi - lo), end - start)
                own = np.concatenate([h[a:b] for a, b in zip(start, end)]) if len(at) else h
                both = np.unique(np.stack([at.astype(np.uint64), own]), axis=1)
                who = pa.array(both[0].astype(np.int64) + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(mix(both[1]).view(np.int64)), pa.array(cell(both[1]).astype(np.int32))], names=["item", "block", "hash", "cell"])

    return items.select("item", "block", "text").mapInArrow(run, "item long, block int, hash long, cell int")


class Table:
    """What goes to every worker: the group of items that each cell stands for (0: none), and of each group how
    many of its own substrings, and of them and shared ones together, a document must hold at least."""

    def __init__(self, grams: DataFrame):
        group = (F.pmod("item", F.lit(GROUPS)) + 1).cast("int")
        shared = grams.groupBy("cell").agg(F.min(group).alias("a"), F.max(group).alias("b")).select("cell", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(SHARED).alias("g"))
        got = shared.toPandas()  # CELLS rows at most
        self.group = np.zeros(CELLS, np.uint8)
        self.group[got["cell"].to_numpy(np.int64)] = got["g"].to_numpy(np.uint8)
        sizes = grams.join(shared.where(F.col("g") == SHARED), "cell", "left").groupBy("item").agg(F.count("*").alias("n"), F.count("g").alias("m"))
        least = F.ceil(SHARE * F.col("n"))
        need = sizes.groupBy(group.alias("g")).agg(F.min(least - F.col("m")).alias("own"), F.min(least).alias("all")).collect()  # GROUPS rows at most
        self.own, self.all = np.full(256, 1 << 40), np.full(256, 1 << 40)
        for r in need:
            self.own[r.g], self.all[r.g] = r.own, r.all

    def passed(self, of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Which of n documents may hold an item, by the number of the document and the hash of each hit."""
        seen = np.unique(np.stack([of.astype(np.uint64), h]), axis=1)
        count = np.bincount(seen[0].astype(np.int64) * 256 + self.group[cell(seen[1])], minlength=n * 256).reshape(n, 256)
        return np.flatnonzero(((count >= self.own) & (count + count[:, SHARED:] >= self.all)).any(axis=1))


def passages(documents: DataFrame, table: Table) -> DataFrame:
    """(doc_id, start_at, passage, hashes): of the documents that may hold an item, the longest stretches all of
    whose substrings are in the table."""
    shared = documents.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(it):
        known = shared.value
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_by_size(texts, 100_000):
                h, start, end = hashes(texts[lo:hi])
                hit = np.flatnonzero(known.group[cell(h)])
                of = np.searchsorted(start, hit, "right") - 1  # empty texts end where the next begins: the last is it
                ok = hit < end[of]
                hit, of = hit[ok], of[ok]
                rows = []
                for i in known.passed(of, h[hit], hi - lo) if len(hit) else ():
                    own = hit[np.searchsorted(of, i) : np.searchsorted(of, i, "right")]
                    place, text = offsets(texts[lo + i]), texts[lo + i]
                    for stretch in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                        x, y = int(place[stretch[0] - start[i]]), int(place[stretch[-1] - start[i] + K - 1]) + 1
                        rows.append((int(i) + lo, x, text[x:y], np.unique(mix(h[stretch])).view(np.int64)))
                if rows:
                    at, x, p, g = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(x, pa.int32()), pa.array(p, pa.string()), pa.array(list(g), pa.list_(pa.int64()))], names=["doc_id", "start_at", "passage", "hashes"])

    src = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, start_at int, passage string, hashes array<long>")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, start_at, end_at): documents that hold at least half of an
    item's distinct 12-character substrings, and where.

    Null texts and ids are left out; items of fewer than 12 letters and digits are never held. A
    document row that repeats is reported once; the same text under several ids under each. An item_id with
    several texts counts as several items and is reported once.
    """
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = int(chars // BLOCK_CHARS + 1)
    numbers = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int")).withColumn("item", F.xxhash64("text", "item_id"))
    known = materialize(numbers, "items")
    grams = materialize(item_hashes(known), "item_hashes")
    p = materialize(passages(documents, Table(grams)), "passages")
    # the blocks that a document has to meet, and the characters each block will scan
    at = p.select("doc_id", F.explode("hashes").alias("hash")).distinct().join(grams.select("hash", "block").distinct(), "hash").select("doc_id", "block").distinct()
    work = materialize(p.select("doc_id", "start_at", "passage").distinct().join(at, "doc_id"), "work")
    slices = work.groupBy("block").agg((F.floor(F.sum(F.length("passage")) / SLICE_CHARS) + 1).cast("int").alias("slices"))
    mine = work.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    theirs = known.join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def scan(i: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        own = Items(list(zip(i["item_id"].tolist(), i["text"])))
        rows = [(d, *x) for d, g in w.groupby("doc_id") for x in own.scan(list(zip(g["start_at"].tolist(), g["passage"])))]
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shared", "n_item", "start_at", "end_at"])

    found_ = theirs.select("block", "slice", "item_id", "text").groupBy("block", "slice").cogroup(mine.select("block", "slice", "doc_id", "start_at", "passage").groupBy("block", "slice")).applyInPandas(scan, _LEAKS)
    return found_.dropDuplicates(["doc_id", "item_id"])


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of all leaks."""
    return leaks(documents, items).select("doc_id", "item_id")
