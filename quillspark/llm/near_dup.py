"""Problem 2: near-duplicate records with small edits.

Two records are near-duplicates when the sets of distinct 5-character substrings of their folded
texts have a Jaccard similarity of 0.6 or more.

Method: a size-aware heavy-light set join. Equal folded texts are one set. Small (light) sets are
joined through enumerated subsets of fixed size: each set gives, for each of BANDS designs, the
subset of SUBSET of its elements that follow SUBSET fixed points on the hash circle, and sets that
share a subset are candidates. A pair of similarity s shares the subset of one design with
probability s^4, so that one of similarity 0.65 is missed in 0.3 % and one of 0.75 in 0.001 % of
cases; a 192-bit sketch then drops candidates far below the threshold. Large (heavy) sets, whose
partners are large as well, are found by scanning the inverted lists of their rarest elements,
which is exact. The boundary is chosen by estimated cost: as many of the largest sets are heavy as
scanning takes a twentieth of the cost of enumerating. Sets of fewer than SMALL elements, for which
points often agree by chance of the gaps between few elements and designs miss most, are found by
their lists in the same exact way. Every remaining candidate is verified on its texts.

Full enumeration of the subsets that the overlap bound asks for (240 of 400 elements) is not
feasible; the designs above are a fixed part of it. The README says so.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .components import connected_components
from .fold import batches_by_size, code_points, fold, gram_hashes, mix

GRAM, THRESHOLD = 5, 0.6
BANDS, SUBSET, SKETCH_BITS = 30, 4, 192
#: Of SKETCH_BITS, as many may differ; for similarity 0.6 the mean is 38.4 and the deviation 5.5.
MAX_DIFFERENT = 58
#: Pairs whose smaller set has fewer elements are found by inverted lists, since these are short for them.
SMALL = 100
#: Of the rows with one key, more than so many are compared in blocks.
RUN = 4096
#: Bits that tell which texts any candidate names.
END_BITS = 1 << 26
#: For the choice of the boundary only: how often two prefix elements are equal, and the cost of one
#: enumerated subset or list entry (hashing, shuffling, sorting) in steps along an inverted list, and
#: what scanning may cost beside enumerating.
COLLISION, SUBSET_COST, SCAN_SHARE = 1.6e-5, 10.0, 0.05
#: Counters for the rarity order of elements; it must be fixed, but need not be exact.
RARITY_CELLS = 1 << 16
_RNG = np.random.default_rng(20250101)
_POINTS = np.sort(_RNG.integers(0, 1 << 48, BANDS * SUBSET + SKETCH_BITS, dtype=np.uint64))
_ORDER = _RNG.permutation(len(_POINTS))
_LOW48 = np.uint64((1 << 48) - 1)


def text_key(s: str) -> bytes:
    """The 128-bit key of a folded text; its first half serves the search for candidates."""
    import xxhash

    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def gram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements as (text number << 48 | 48-bit hash), sorted; start and size of each text's."""
    cp, lens = code_points(texts)
    h, doc, _ = gram_hashes(cp, lens, GRAM)
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    size = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(texts))
    return key, np.cumsum(size) - size, size


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which texts have elements, subset keys by design, three words of the sketch, set sizes)."""
    key, start, size = gram_sets(texts)
    some = np.flatnonzero(size > 0)
    if len(some) == 0:
        return some, np.empty((0, BANDS), np.int64), np.empty((0, 3), np.int64), size
    at = np.searchsorted(key, (some.astype(np.uint64)[:, None] << np.uint64(48)) | _POINTS[None, :])
    end = (start + size)[some][:, None]
    at = np.where(at >= end, start[some][:, None], at)  # past the last element: around to the first
    value = (key[at] & _LOW48)[:, _ORDER]
    with np.errstate(over="ignore"):
        sub = value[:, : BANDS * SUBSET].reshape(len(some), BANDS, SUBSET)
        k = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(some), BANDS))
        for j in range(SUBSET):
            k = mix(k ^ sub[:, :, j])
        bits = mix(value[:, BANDS * SUBSET :] + np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) & np.uint64(1)
    sketch = np.packbits(bits.astype(np.uint8), axis=1).reshape(len(some), -1).copy().view(np.int64)
    return some, k.view(np.int64), sketch, size


def elements(s: str) -> frozenset[str]:
    return frozenset([s[i : i + GRAM] for i in range(len(s) - GRAM + 1)])


def jaccard(a: str, b: str, of=elements) -> float:
    """Similarity of two folded texts; of texts without elements, 1 if they are equal."""
    x, y = of(a), of(b)
    if not x or not y:
        return float(a == b)
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return 0.0
    n = len(x & y)
    return n / (len(x) + len(y) - n)


def folded_texts(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, tid, n, text): the key of the folded text, its first half and the length; text is null where
    the same task has already given it, so that copies travel on only once per task."""

    def run(it):
        seen: set[bytes] = set()
        for batch in it:
            texts = [fold(t) for t in batch.column(1).to_pylist()]
            keys = [text_key(t) for t in texts]
            out = []
            for k, t in zip(keys, texts):
                out.append(None if k in seen else t)
                if len(seen) > 1_000_000:  # bounded memory; a text sent twice is no error
                    seen.clear()
                seen.add(k)
            tid = np.frombuffer(b"".join(keys), np.int64)[::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(tid), pa.array([len(t) for t in texts], pa.int32()), pa.array(out, pa.string())], names=["id", "key", "tid", "n", "text"])

    src = records.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"(?U)\S")).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "id string, key binary, tid long, n int, text string")


def pairs_within(rows: DataFrame, keep, run: int | None = RUN) -> DataFrame:
    """(a, b): the tids, the smaller first, of all two rows (k, tid, ...) with equal k for which keep(x, y) holds;
    x and y are lists of equally long arrays, the columns of either row. A pair may come more than once.

    The rows are sorted by k, and neighbours are compared array by array, so that rows travel once. Keys
    with more than `run` rows are not compared there: their rows are dealt to blocks of about that many, and
    each two blocks are compared on their own, wherever they fall.
    """
    names = rows.columns
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    schema = f"a long, b long, {fields}"

    def scan(it):
        kinds = [x.type for x in types]

        def deferred(cols):
            none = pa.nulls(len(cols[0]), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["a", "b", *names])

        def compare(cols):
            """Batches of the pairs within the runs of equal k."""
            k = cols[0]
            at, d, got, size = np.arange(len(k)), 0, [], 0
            while True:
                d += 1
                at = at[at + d < len(k)]
                at = at[k[at] == k[at + d]]
                if len(at) == 0:
                    break
                for lo in range(0, len(at), 1 << 16):
                    i = at[lo : lo + (1 << 16)]
                    ok = keep([c[i] for c in cols], [c[i + d] for c in cols])
                    x, y = cols[1][i[ok]], cols[1][i[ok] + d]
                    got.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                    size += len(x)
                if size > 1 << 17:
                    yield np.unique(np.concatenate(got, axis=1), axis=1)
                    got, size = [], 0
            if size:
                yield np.unique(np.concatenate(got, axis=1), axis=1)

        def as_pairs(p):
            n = p.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), *(pa.nulls(n, t) for t in kinds)], names=["a", "b", *names])

        carry, hot = None, None
        for batch in it:
            if batch.num_rows == 0:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols)]
            k, tid = cols[0], cols[1]
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (tid[1:] != tid[:-1])])  # the same text from several tasks
            cols = [c[fresh] for c in cols]
            k = cols[0]
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            length = np.diff(np.append(edge, len(k)))
            long = np.zeros(len(edge), bool) if run is None else length > run
            if hot is not None and k[0] == hot:
                long[0] = True
            hot = k[-1] if long[-1] else None
            # the last run goes on in the next batch, unless it is a long one already
            stop = len(k) if long[-1] else edge[-1]
            carry = None if long[-1] else [c[stop:] for c in cols]
            out = np.repeat(long, length)
            if out.any():
                yield deferred([c[out] for c in cols])
            ready = ~out
            ready[stop:] = False
            for p in compare([c[ready] for c in cols]):
                yield as_pairs(p)
        if carry is not None:
            for p in compare(carry):
                yield as_pairs(p)

    types = to_arrow_schema(rows.schema)
    scanned = rows.repartition("k").sortWithinPartitions("k", "tid").mapInArrow(scan, schema)
    if run is None:
        return scanned.select("a", "b")
    scanned = materialize(scanned, "pairs")
    rest = scanned.where("a is null").select(*names)
    blocks = rest.groupBy("k").agg(F.ceil(F.count("*") / run).cast("int").alias("blocks"))
    own = rest.join(blocks, "k").withColumn("block", F.pmod(F.xxhash64("tid", F.lit(1)), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other").cast("int")).withColumn("hi", F.greatest("block", "other").cast("int"))
    cells = cells.select(F.xxhash64("k", "lo", "hi").alias("k"), *names[1:], "block", "lo", "hi")

    def keep_cell(x, y):
        b, c = np.minimum(x[-3], y[-3]), np.maximum(x[-3], y[-3])
        ok = (b == x[-2]) & (c == x[-1])
        ok[ok] = keep([v[ok] for v in x[:-3]], [v[ok] for v in y[:-3]])
        return ok

    return scanned.where("a is not null").select("a", "b").union(pairs_within(cells, keep_cell, None))


def boundary(lengths: list[tuple[int, int, float]]) -> int:
    """The size from which sets are heavy: the least one at which scanning the lists costs no more than
    SCAN_SHARE of enumerating the subsets of all sets.

    lengths: (least size of the class, number of sets, mean size), a bounded number of classes.
    """
    classes = sorted(lengths)
    budget = SCAN_SHARE * SUBSET_COST * BANDS * sum(c for _, c, _ in classes)
    for s, _, _ in classes:
        prefix = (1 - THRESHOLD) * sum(c * m for a, c, m in classes if a >= THRESHOLD * s)
        if SUBSET_COST * prefix + prefix * prefix * COLLISION / 2 <= budget:
            return s
    return 1 << 62


def apart(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """In how many bits two sketches differ."""
    return sum(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) for a, b in zip(x, y))


def light_candidates(texts: DataFrame, heavy_from: int) -> DataFrame:
    """(a, b): keys of texts that share an enumerated subset and whose sketches are near; sets of fewer
    than SMALL elements are left to `small_candidates`."""

    def run(it):
        for batch in it:
            keys, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in batches_by_size(words):
                some, sub, sketch, size = signatures(words[a:b])
                light = (size[some] < heavy_from) & (size[some] >= SMALL)
                some, sub, sketch = some[light], sub[light], sketch[light]
                if len(some) == 0:
                    continue
                rep = lambda x: pa.array(np.repeat(x, BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(sub.ravel()), rep(keys[a:b][some]), rep(sketch[:, 0]), rep(sketch[:, 1]), rep(sketch[:, 2])], names=["k", "tid", "s1", "s2", "s3"])

    sets = texts.select("tid", "text").mapInArrow(run, "k long, tid long, s1 long, s2 long, s3 long")
    return pairs_within(sets, lambda x, y: apart(x[2:], y[2:]) <= MAX_DIFFERENT).distinct()


def heavy_candidates(texts: DataFrame, heavy_from: int) -> DataFrame:
    """(a, b): pairs with a heavy set that meet in an inverted list of rare elements; exact."""
    large = texts.where(F.col("n") >= THRESHOLD * heavy_from).select("tid", "text")
    return list_candidates(large, lambda low, big: big >= heavy_from)


def small_candidates(texts: DataFrame) -> DataFrame:
    """(a, b): pairs with a set of fewer than SMALL elements that meet in an inverted list; exact.

    A long text may have few distinct elements, so that all texts are looked at."""

    def run(it):
        for batch in it:
            words = batch.column(1).to_pylist()
            for a, b in batches_by_size(words):
                _, _, size = gram_sets(words[a:b])
                keep = pa.array((size > 0) & (size * THRESHOLD < SMALL))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(keep), batch.column(1).slice(a, b - a).filter(keep)], names=["tid", "text"])

    few = materialize(texts.select("tid", "text").mapInArrow(run, "tid long, text string"), "small")
    return list_candidates(few, lambda low, big: low < SMALL)


def list_candidates(large: DataFrame, wanted) -> DataFrame:
    """(a, b): pairs of the sets (tid, text) that share one of their rarest elements, if `wanted` of their
    lesser and greater size; exact."""

    def count(it):
        cells = np.zeros(RARITY_CELLS, np.int64)
        for batch in it:
            words = batch.column(1).to_pylist()
            for a, b in batches_by_size(words):
                key, _, _ = gram_sets(words[a:b])
                cells += np.bincount((key & np.uint64(RARITY_CELLS - 1)).astype(np.int64), minlength=RARITY_CELLS)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], names=["cell", "n"])

    rarity = np.zeros(RARITY_CELLS, np.int64)
    for r in large.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # RARITY_CELLS rows at most
        rarity[r.cell] = r.n

    def prefix(it):
        for batch in it:
            keys, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in batches_by_size(words):
                key, start, size = gram_sets(words[a:b])
                doc, g = (key >> np.uint64(48)).astype(np.int64), key & _LOW48
                o = np.lexsort((g, rarity[(g & np.uint64(RARITY_CELLS - 1)).astype(np.int64)], doc))
                rank = np.arange(len(o)) - start[doc]
                # parity of the elements by cell: two sets differ in as many elements as bits at least
                odd = np.bincount(doc * SKETCH_BITS + (g % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=(b - a) * SKETCH_BITS) & 1
                bits = np.packbits(odd.astype(np.uint8)).reshape(b - a, -1).view(np.int64)
                keep = rank < (size - np.ceil(THRESHOLD * size - 1e-9) + 1)[doc]
                g, doc, rank = g[o][keep], doc[keep], rank[keep]
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(keys[a:b][doc]), pa.array(size[doc].astype(np.int32)), pa.array(rank.astype(np.int32)), *(pa.array(bits[doc, j]) for j in range(3))], names=["k", "tid", "size", "rank", "s1", "s2", "s3"])

    def meets(x, y):
        (sx, rx), (sy, ry) = x[2:4], y[2:4]
        low, big, both = np.minimum(sx, sy), np.maximum(sx, sy), sx + sy
        # at the first element they share, what is left must suffice for the overlap that the threshold asks for;
        # a pair that is kept at a later element is kept at its first one too
        enough = np.minimum(sx - rx, sy - ry) + np.minimum(rx, ry) >= THRESHOLD / (1 + THRESHOLD) * both - 1e-6
        few = apart(x[4:], y[4:]) <= (1 - THRESHOLD) / (1 + THRESHOLD) * both + 1e-6
        return wanted(low, big) & (low >= THRESHOLD * big) & enough & few

    return pairs_within(large.mapInArrow(prefix, "k long, tid long, size int, rank int, s1 long, s2 long, s3 long"), meets).distinct()


def texts_named(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """The texts (tid, key, text) that ends (tid) may name: all of them and, by chance, some others. What goes to
    the workers is a table of END_BITS bits, whatever the number of texts; the join that follows is exact."""

    def bits(it):
        for batch in it:
            at = np.unique(batch.column(0).to_numpy(zero_copy_only=False) & (END_BITS - 1))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    got = ends.mapInArrow(bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # END_BITS / 64 rows at most
    table = np.zeros(END_BITS // 64, np.uint64)
    table[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(it):
        words = shared.value
        for batch in it:
            at = batch.column(0).to_numpy(zero_copy_only=False) & (END_BITS - 1)
            yield batch.filter(pa.array(((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 1))

    return texts.mapInArrow(run, "tid long, key binary, text string")


def verify(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the candidates that reach the threshold on their texts; a and b are whole keys."""

    def run(it):
        of = lru_cache(256)(elements)  # pairs of one text come one after the other
        for batch in it:
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            s = np.array([jaccard(x, y, of) for x, y in zip(ta, tb)], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["a", "b", "similarity"])

    t = texts_named(texts.select("tid", "key", "text"), candidates.select(F.explode(F.array("a", "b")).alias("tid"))).dropDuplicates(["tid", "key"])
    both = candidates.join(t.select(F.col("tid").alias("a"), F.col("key").alias("ka"), F.col("text").alias("ta")), "a").join(t.select(F.col("tid").alias("b"), F.col("key").alias("kb"), F.col("text").alias("tb")), "b")
    return both.select("ka", "kb", "ta", "tb").mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= THRESHOLD - 1e-12)


class NearDuplicates:
    """The links between different texts, and the membership of records in classes of equal texts."""

    def __init__(self, records: DataFrame, id_col: str = "chunk_id", text_col: str = "text"):
        """Null and blank texts and null ids take no part; rows repeated with one id count once;
        texts shorter than 5 characters have no elements and match only equal texts."""
        all_rows = materialize(folded_texts(records, id_col, text_col), "folded")
        # by text, so that the joins below need no further exchange
        self.members = all_rows.select("id", "key").repartition("key").distinct()
        texts = all_rows.where("text is not null").select("tid", "key", "n", "text")
        classes = texts.groupBy(F.floor(F.log2(F.col("n") + 1) * 8).alias("c")).agg(F.min("n"), F.count("*"), F.avg("n")).collect()  # 8 per doubling
        self.heavy_from = boundary([(r[1], r[2], r[3]) for r in classes])
        pairs = light_candidates(texts, self.heavy_from).union(small_candidates(texts)).distinct()
        if self.heavy_from < 1 << 62:
            pairs = pairs.union(heavy_candidates(texts, self.heavy_from)).distinct()
        self.links = materialize(verify(materialize(pairs, "candidates"), texts), "links")

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of all near-duplicate records, the smaller id first."""
        m = self.members
        equal = m.alias("a").join(m.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
        x = self.links.join(m.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
        return equal.union(x.where("x <> y").select(F.least("x", "y"), F.greatest("x", "y"))).distinct()

    def groups(self) -> DataFrame:
        """(id, text_key, group_key, n_links): each record, its class of equal texts, its group and
        the number of other texts that its own is linked with. Alone, a record is its own group."""
        links = self.links.select(F.hex("a").alias("a"), F.hex("b").alias("b"))
        comp = connected_components(links, "a", "b")
        deg = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
        return (
            self.members.select("id", F.hex("key").alias("key")).join(comp.withColumnRenamed("node", "key"), "key", "left").join(deg, "key", "left")
            .select("id", F.col("key").alias("text_key"), F.coalesce("component", "key").alias("group_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        )


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b) of all near-duplicate chunks."""
    return NearDuplicates(chunks).pairs().toDF("chunk_id_a", "chunk_id_b")
