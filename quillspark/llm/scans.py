"""Problem 4: noise in text from scanned pages.

Method: word counts and skip-gram statistics over all pages; rare words are linked to frequent
neighbours by plausible glyph edits; corrections are chosen in the context of each occurrence; then
running lines and page numbers are removed, split words joined and the lines reflowed.

Which glyph edits are plausible for Hangul is learnt: syllables that look alike and that stand for
each other, in one direction, in many pairs of a rare and a frequent word. For Latin
letters and digits the shapes are a fixed list. The skip-gram vectors come from the factorised
matrix of positive pointwise mutual information between frequent words and hashed context words,
which is what skip-gram training with negative samples factorises; its counts cover all pages and
its size is fixed.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .names import parts

EDGE_LINES, PAGES, CONTEXTS, DIMENSIONS, WINDOW, LEAST_SEEN = 2, 24, 256, 48, 2, 3
#: How often a shape of Latin letters is misread, the logarithm of how likely a rare word that is near a
#: frequent one is a word of its own, and how likely at least a word with one misread letter has another.
LATIN_RATE, LOG_OWN, MORE = 0.02, -5.0, 0.3
# Marks at a line's end that divide a word, and letters that scans take for others.
DIVIDERS = "-–‐‑­¬"
LATIN_SHAPES = (("rn", "m"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("1", "l"), ("0", "o"), ("c", "e"), ("5", "s"), ("8", "b"), ("ii", "u"))
DIGIT_SHAPES = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2"}
# Signs that occur inside of words and numbers, and units that follow numbers.
_INNER = "·.,:;/()%&+'’‘“”\"-–‐‑­¬[]|@#"
_UNITS = "년|월|일|분|초|시|건|명|회|점|개|등급|단계|부|원|차|종|주|식|쪽|면|장|대|권|층|개월|세|인|MB|GB|TB|KB|%"
_NUMBER = re.compile(rf"(?<![A-Za-z])[0-9OolISBZ](?:[0-9OolISBZ.,]*[0-9OolISBZ])?(?=(?:{_UNITS}|[^A-Za-z0-9]|\Z))")
_CODE = re.compile(r"(?<=[A-Z]{2}[-‐‑–])[0-9OolISBZ]*[0-9][0-9OolISBZ]*(?![A-Za-z0-9])|(?<=[A-Z]{3}[-‐‑–])[0-9OolISBZ]{3}(?![A-Za-z0-9])")
_ROMAN = re.compile(r"[ivxlc]{1,8}|[IVXLC]{1,8}")
_PAGE = re.compile(r"^[\s\-–—―‐~·\[\(<【〔|]*(?:[Pp]age|PAGE|[Pp]g|[Pp]|쪽|면|제)?\s*\.?\s*([0-9OolISBZ]{1,5})(?:\s*(?:/|of|중)\s*[0-9OolISBZ]{1,5})?\s*(?:쪽|면|페이지|[Pp]age|p)?[\s\-–—―‐~·\]\)>】〕|]*$")
_ARTICLE = re.compile(r"^\s*제\s*[0-9OolISBZ]+\s*[조장절항관]")
_LABEL = "이미지 OCR 텍스트:"
_WORD = re.compile(r"[^\s]+")


def is_page_number(line: str) -> bool:
    """A line that holds nothing but a page number, in any of the usual forms."""
    s = line.strip()
    if m := _PAGE.match(s):
        n = m.group(1)
        # letters that scans take for digits count as such only beside a digit or page marks
        return any(c.isdigit() for c in n) or s != n
    return _ROMAN.fullmatch(s.strip("-–— []()")) is not None


def core(token: str) -> str:
    """The word within a token, without the marks around it."""
    return token.strip(".,:;()[]\"'“”‘’·-–‐‑­¬!?%")


def line_key(line: str) -> str:
    """What identifies a running line whose page number changes: its letters."""
    return "".join(c for c in line if c.isalpha()).lower()


def differing(a: str, b: str) -> int:
    """In how many of initial, medial and final two syllables differ; 3 for other characters."""
    return sum(x != y for x, y in zip(parts(a), parts(b))) if "가" <= a <= "힣" and "가" <= b <= "힣" else 3


_LATIN_WORD = re.compile(r"[A-Za-z0-9\-]*[a-z][A-Za-z0-9\-]*")
#: Of each Latin letter, the simplest shapes that it may be seen as; a letter and its misread form have the same.
_EXPANDED = {b: a for a, b in LATIN_SHAPES if len(a) > 1} | {"1": "l", "0": "o", "c": "e", "5": "s", "8": "b"}
_EXPANDED["d"] = "el"
_NUMERIC = re.compile(r"^[0-9A-Za-z.,%\-]*[0-9A-Z%](?=[가-힣]+$)")


def shape(token: str) -> tuple[str, str]:
    """(what stands before, word): the word of a token; after a number or code, '#' and what is joined to it."""
    w = core(token)
    m = _NUMERIC.match(w)
    return (m.group(), "#" + w[m.end() :]) if m else ("", w)


def line_tokens(lines: list[str]) -> list[tuple[list[str], bool]]:
    """Of each line, its tokens and whether a divided word goes on in the next one."""
    out = []
    for line in lines:
        t = line.split()
        out.append((t, bool(t) and len(t[-1]) > 1 and t[-1][-1] in DIVIDERS and t[-1][-2].isalpha()))
    return out


def glyph_key(word: str, classes: dict[str, str]) -> str:
    """What a word and all that it may be misread as have in common: syllables of one class are one, and of
    Latin letters each is written as the shapes it consists of. Plain substitution character by character, so
    that any number of edits anywhere in the word leaves it as it is."""
    return "".join(classes.get(c, c) for c in word) if re.search("[가-힣]", word) else "".join(_EXPANDED.get(c, c) for c in word.lower())


def _log_share(rates: list[float]) -> float:
    """Misread letters come together: after the first of a word, others are likelier."""
    return math.log(rates[0]) + sum(math.log(max(r, MORE)) for r in rates[1:])


def log_misread(word: str, right: str, edits: dict[str, dict[str, float]]) -> float | None:
    """The logarithm of the share in which scans show `right` as `word` by glyph edits; None if they never do."""
    if re.search("[가-힣]", word):
        if len(word) != len(right):
            return None
        rates = [edits.get(x, {}).get(y) for x, y in zip(word, right) if x != y]
        return None if not rates or None in rates else _log_share(sorted(rates))
    if not _LATIN_WORD.fullmatch(word):
        return None
    low, states = word.lower(), {(0, 0): 0}  # the fewest edits by (read of word, written of right)
    for i in range(len(word)):
        for (_, j), n in [x for x in states.items() if x[0][0] == i]:
            steps = [(i + 1, j + 1, n)] if word[i] == right[j : j + 1] else []
            steps += [(i + len(a), j + 1, n + 1) for a, b in LATIN_SHAPES if low.startswith(a, i) and right[j : j + 1] == b]
            for x, y, m in steps:
                states[x, y] = min(m, states.get((x, y), m))
    n = states.get((len(word), len(right)))
    return _log_share([LATIN_RATE] * n) if n else None


def fix_numbers(token: str) -> str:
    """Letters that scans take for digits, put right in numbers and codes."""

    def one(m: re.Match) -> str:
        g = m.group()
        alone = not any(c.isdigit() for c in g)
        rest = token[m.end() :]
        if alone and not (re.match(_UNITS, rest) and (g in ("l", "S", "B", "O", "lO", "ll", "lS", "lB", "I", "Z") or len(g) > 1) and not rest.startswith(("MB", "GB", "TB", "KB"))):
            return g
        if alone and g in ("S", "B", "O", "I", "Z") and not re.match(r"월|일|분|초|시간|건|명|회|점|개|등급|단계|부|차|종|년", rest):
            return g
        return "".join(DIGIT_SHAPES.get(c, c) for c in g)

    return _CODE.sub(lambda m: "".join(DIGIT_SHAPES.get(c, c) for c in m.group()), _NUMBER.sub(one, token))


def drop_strays(token: str) -> str:
    """The token without signs that stand between its letters or digits and belong to none."""
    out = []
    for i, c in enumerate(token):
        if not c.isalnum() and c not in _INNER:
            if 0 < i < len(token) - 1 or len(token) == 1:
                continue
        out.append(c)
    return "".join(out)


def pages(images: DataFrame) -> DataFrame:
    """(field_name, record_id, doc_id, file_name, page, text): the text of scanned pages; combined_context only where
    ocr_text is null. Records with neither are left out, and repeated records count once."""
    p = images.where("source_type = 'page_scan' and record_id is not null").select(
        F.when(F.col("ocr_text").isNotNull(), "ocr_text").otherwise("combined_context").alias("field_name"),
        F.col("record_id").cast("long").alias("record_id"), "doc_id", "file_name",
        (F.col("image_number") if "image_number" in images.columns else F.lit(None)).cast("long").alias("page"), F.coalesce("ocr_text", "combined_context").alias("text"),
    )
    return p.where("text is not null").dropDuplicates(["record_id"])


def furniture(p: DataFrame) -> DataFrame:
    """(record_id, line_no, noise, key): running lines and page numbers among the first and last lines.

    A line is a running one if its letters recur at the edges of other pages of its document, or of
    PAGES pages that follow each other there: two pages at least, and a twelfth of them; or if it is that near to such a line (a third of its
    letters, for misread ones), or begins like the title in the file's name. Pages without doc_id belong together by
    file_name. Only counts per document and line leave the pages.
    """

    def edges(it):
        for batch in it:
            rows = []
            for r, d, t, f in zip(*(batch.column(i).to_pylist() for i in range(4))):
                title = line_key((f or "").rpartition(".")[0].partition("_")[2])
                lines = [(n, s) for n, s in enumerate(t.split("\n"), 1) if s.strip() and s.strip() != _LABEL]
                for n, s in {*lines[:EDGE_LINES], *lines[-EDGE_LINES:]}:
                    page = is_page_number(s)
                    top = (n, s) in lines[:EDGE_LINES]
                    key = "" if page or _ARTICLE.match(s) else line_key(s)
                    if page or len(key) >= 2:
                        rows.append((r, d, n, top, page, key, not s.strip().endswith("."), len(title) >= 8 and key[:12] == title[:12]))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["record_id", "doc_id", "line_no", "top", "page", "key", "open", "title"])

    whose = F.coalesce("doc_id", F.concat(F.lit("\0"), "file_name"), F.lit("")).alias("doc_id")
    # the whole document, and stretches of PAGES pages that overlap by half
    parts_of = F.array_compact(F.array(F.lit(""), F.concat(F.lit("a"), F.floor(F.col("page") / PAGES)), F.concat(F.lit("b"), F.floor((F.col("page") + PAGES // 2) / PAGES))))
    stretches = p.select("record_id", F.explode(parts_of).alias("stretch"))
    e = materialize(p.select("record_id", whose, "text", "file_name").mapInArrow(edges, "record_id long, doc_id string, line_no int, top boolean, page boolean, key string, open boolean, title boolean"), "edges")
    n_pages = p.select(whose, F.explode(parts_of).alias("stretch")).groupBy("doc_id", "stretch").agg(F.count("*").alias("n_pages"))
    whole = e.where("not page")
    lines = whole.join(stretches, "record_id")
    counts = lines.groupBy("doc_id", "stretch", "top", "key").agg(F.count("*").alias("n"))
    runs = counts.join(n_pages, ["doc_id", "stretch"]).where((F.col("n") >= 2) & (F.col("n") * 12 >= F.col("n_pages")))
    # of a stretch, at most 12 running lines can reach a twelfth of its pages on either edge and place
    ranked = runs.withColumn("k", F.row_number().over(W.partitionBy("doc_id", "stretch", "top").orderBy(F.desc("n"), "key"))).where("k <= 24").select("doc_id", "stretch", "top", F.col("key").alias("run"), F.col("n").alias("n_run"))
    near = (F.col("key") == F.col("run")) | (F.levenshtein("key", "run") * 3 <= F.length("run"))
    headers = lines.join(ranked, ["doc_id", "stretch", "top"]).where(near & (F.col("open") | (F.col("n_run") >= 3))).select("record_id", "line_no").union(whole.where("title and open").select("record_id", "line_no")).distinct().withColumn("noise", F.lit("header"))
    return headers.union(e.where("page").select("record_id", "line_no", F.lit("page_number")))


def words_of(p: DataFrame) -> DataFrame:
    """(record_id, word, context): the words of the pages and, hashed, those within WINDOW of them.
    Words divided at line ends are joined."""

    def run(it):
        import xxhash

        for batch in it:
            rec, words, ctx = [], [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                carried = ""
                for tokens, divided in line_tokens(t.split("\n")):
                    if carried and tokens:
                        tokens = [carried + tokens[0], *tokens[1:]]
                        carried = ""
                    if divided:
                        carried, tokens = tokens[-1][:-1], tokens[:-1]
                    own = [w for w in (shape(x)[1] for x in tokens) if w and not any(c.isdigit() for c in w if c not in "10")]
                    hashed = [xxhash.xxh32_intdigest(w) % CONTEXTS for w in own]
                    for i, w in enumerate(own):
                        rec.append(r)
                        words.append(w)
                        ctx.append(hashed[max(0, i - WINDOW) : i] + hashed[i + 1 : i + 1 + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(words, pa.string()), pa.array(ctx, pa.list_(pa.int32()))], names=["record_id", "word", "context"])

    return p.select("record_id", "text").mapInArrow(run, "record_id long, word string, context array<int>")


def context_rows(words: DataFrame) -> DataFrame:
    """(word, context, total): how often each word stands beside each hashed context, as (c, n); CONTEXTS
    entries of a word at most. Every occurrence on every page counts."""

    def run(it):
        for batch in it:
            w = batch.column(0).dictionary_encode()
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            pair = np.repeat(w.indices.to_numpy(zero_copy_only=False).astype(np.int64), size) * CONTEXTS + lists.flatten().to_numpy(zero_copy_only=False)
            at, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([w.dictionary.take(pa.array(at // CONTEXTS)), pa.array((at % CONTEXTS).astype(np.int32)), pa.array(n)], names=["word", "c", "n"])

    pairs = words.select("word", "context").mapInArrow(run, "word string, c int, n long").groupBy("word", "c").agg(F.sum("n").alias("n"))
    return pairs.groupBy("word").agg(F.collect_list(F.struct("c", "n")).alias("context"), F.sum("n").alias("total"))


class Space:
    """The skip-gram space: shares of the contexts and their vectors. Its size is fixed."""

    def __init__(self, shares: np.ndarray, vectors: np.ndarray):
        self.shares, self.vectors = shares, vectors

    def association(self, counts: np.ndarray) -> np.ndarray:
        """How much oftener than by chance each word (a row) stands beside each context, as a logarithm that
        is near 0 where there is little to go by."""
        return np.log((counts + 1) / (counts.sum(axis=-1, keepdims=True) * self.shares + 1))

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return (self.association(counts) @ self.vectors).astype(np.float32)

    def fit(self, vector: np.ndarray, near: list[int]) -> float:
        """How well a word goes with the contexts around a place."""
        return float(self.vectors[near].sum(axis=0) @ vector) if near else 0.0


def dense_rows(column) -> np.ndarray:
    """Lists of (c, n) as rows of counts."""
    items, out = column.flatten(), np.zeros((len(column), CONTEXTS))
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    out[row, items.field("c").to_numpy(zero_copy_only=False)] = items.field("n").to_numpy(zero_copy_only=False)
    return out


def skip_gram_space(rows: DataFrame) -> Space:
    """The space of context_rows: the main directions of the associations of all words seen LEAST_SEEN times.

    The tasks add up products of contexts with contexts; what reaches the driver is one matrix of
    CONTEXTS by CONTEXTS, whatever the number of words.
    """
    n = np.zeros(CONTEXTS)
    for r in rows.select(F.explode("context").alias("x")).groupBy("x.c").agg(F.sum("x.n").alias("n")).collect():  # CONTEXTS rows
        n[r.c] = r.n
    known = Space(n / max(1.0, n.sum()), np.eye(CONTEXTS))
    i, j = np.triu_indices(CONTEXTS)

    def products(it):
        g = np.zeros((CONTEXTS, CONTEXTS))
        for batch in it:
            for lo in range(0, batch.num_rows, 1024):
                a = known.association(dense_rows(pa.concat_arrays([batch.column(0).slice(lo, 1024)])))
                g += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["i", "j", "g"])

    sums = rows.where(F.col("total") >= 2 * WINDOW * LEAST_SEEN).select("context").mapInArrow(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    g = np.zeros((CONTEXTS, CONTEXTS))
    g[sums.i, sums.j] = g[sums.j, sums.i] = sums.g
    return Space(known.shares, np.linalg.eigh(g)[1][:, ::-1][:, :DIMENSIONS])


def learn_edits(counts: DataFrame, least: int = 3) -> dict[str, dict[str, float]]:
    """Misread syllable -> the syllables it stands for, each with the share of its occurrences that are misread
    so, from pairs of a rare and a frequent word."""

    def masks(it):
        for batch in it:
            key, ch, n = [], [], []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, x in enumerate(w):
                    if "가" <= x <= "힣":
                        key.append(w[:i] + "*" + w[i + 1 :])
                        ch.append(x)
                        n.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(ch, pa.string()), pa.array(n, pa.int64())], names=["mask", "ch", "n"])

    m = counts.where(F.length("word") >= 2).select("word", "n").mapInArrow(masks, "mask string, ch string, n long")
    best = materialize(m.groupBy("mask").agg(F.max_by("ch", "n").alias("to"), F.max("n").alias("n_to")).where("n_to >= 4"), "masks")
    rare = F.col("n_to") >= 6 * F.col("n")
    pairs = m.join(best, "mask").where("ch <> to").groupBy("ch", "to").agg(F.count_if(rare).alias("k"), F.count_if(rare | (F.col("n_to") >= 20)).alias("k_all"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("n"), F.count_if(rare & ~F.endswith("mask", F.lit("*"))).alias("k_inner"))
    pairs = pairs.where(F.col("k") >= least).join(best.groupBy("to").agg(F.sum("n_to").alias("n_all")), "to")
    # of ordinary forms of one word neither is always the rare one, and misreading touches all words alike
    got = [(r, d) for r in pairs.where("k >= 0.7 * k_all and n >= 0.006 * n_all").collect() if 1 <= (d := differing(r.ch, r.to)) <= 2]  # pairs of syllables that look alike
    # two letters apart, a pair must not be one of endings only
    got = [r for r, d in got if d == 1 or (r.k >= 2 * least and r.k_inner >= 0.3 * r.k)]
    most = {r.ch: max(x.k for x in got if x.ch == r.ch) for r in got}
    out: dict[str, dict[str, float]] = {}
    for r in sorted(got, key=lambda r: (-r.k, r.ch, r.to)):
        # a syllable is misread for one or few others, and those are no misread ones themselves
        if r.k >= 0.3 * most[r.ch] and most.get(r.to, 0) < r.k:
            out.setdefault(r.ch, {})[r.to] = min(0.5, r.n / r.n_all)
    return out


def syllable_classes(edits: dict[str, dict[str, float]]) -> dict[str, str]:
    """Syllable -> the first syllable of its class; what is misread for each other is of one class."""
    of: dict[str, str] = {}

    def root(x: str) -> str:
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, many in edits.items():
        for b in many:
            x, y = sorted((root(a), root(b)))
            of[y] = x
    return {x: root(x) for x in of}


def corrections(counts: DataFrame, edits: dict[str, dict[str, float]]) -> DataFrame:
    """(word, n, to, n_to, log_p): the rare words that glyph edits lead to a more frequent word, with all such
    words. Both meet in an equality join on their glyph key, whatever the number of edits."""
    classes = syllable_classes(edits)

    def keys(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([glyph_key(w, classes) for w in batch.column(0).to_pylist()], pa.string()), *batch.columns], names=["key", "word", "n"])

    def judged(it):
        for batch in it:
            p = [log_misread(w, v, edits) for w, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=["word", "n", "to", "n_to", "log_p"])

    k = counts.select("word", "n").mapInArrow(keys, "key string, word string, n long")
    pairs = k.join(k.where("n >= 3").select("key", F.col("word").alias("to"), F.col("n").alias("n_to")), "key").where("word <> to and n_to > 2 * n")
    return pairs.select("word", "n", "to", "n_to").mapInArrow(judged, "word string, n long, to string, n_to long, log_p double").where("log_p is not null")


def competitors(pairs: DataFrame, rows: DataFrame, space: Space) -> DataFrame:
    """(word, n, context, options): each rare word with its own contexts and the words that it may be instead,
    with their vectors; contexts and vectors as bytes, since they travel to every page with the word."""

    def embed(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 1024):
                v = space.embed(dense_rows(pa.concat_arrays([batch.column(1).slice(lo, 1024)]))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1024), pa.array([x.tobytes() for x in v], pa.binary())], names=["to", "vector"])

    def pack(it):
        for batch in it:
            items = batch.column(1).flatten()
            both = np.stack([items.field("c").to_numpy(zero_copy_only=False), np.minimum(items.field("n").to_numpy(zero_copy_only=False), 2**31 - 1)], axis=1).astype(np.int32)
            ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.split(both, ends[:-1])], pa.binary())], names=["word", "context"])

    of = lambda c: rows.join(pairs.select(F.col(c).alias("word")).distinct(), "word", "left_semi").select("word", "context")
    vectors = of("to").mapInArrow(embed, "to string, vector binary")
    own = of("word").mapInArrow(pack, "word string, context binary")
    # the words with one glyph key as this one
    options = pairs.join(vectors, "to").groupBy("word", "n").agg(F.collect_list(F.struct("to", "n_to", "log_p", "vector")).alias("options"))
    return options.join(own, "word").select("word", "n", "context", "options")


def choice(word: dict, near: list[int], space: Space) -> str | None:
    """What a rare word (a row of `competitors`) stands for at a place between the contexts `near`: the word
    of highest count, probability of being misread so and fit to the place; None if that is the word itself,
    whose fit rests on its other occurrences."""
    counts = np.zeros(CONTEXTS)
    c, n = np.frombuffer(word["context"], np.int32).reshape(-1, 2).T
    counts[c] = n
    np.subtract.at(counts, near, 1)
    best, most = None, math.log(word["n"]) + LOG_OWN + space.fit(space.embed(np.maximum(counts, 0)), near)
    for o in sorted(word["options"], key=lambda o: o["to"]):
        score = math.log(o["n_to"]) + o["log_p"] + space.fit(np.frombuffer(o["vector"], np.float16).astype(np.float32), near)
        if score > most:
            best, most = o["to"], score
    return best


def repair_page(text: str, marks: dict[int, str], options: dict[str, dict], space: Space) -> tuple[list[tuple[int, str]], str, int]:
    """(noises as (line, kind), repaired text, corrected words) of one page."""
    import xxhash

    lines = text.split("\n")
    noises = [(n, k) for n, k in marks.items()]
    body: list[str] = []
    fixed_words = 0
    joins: list[bool] = []
    carried: tuple[int, str] | None = None
    bad: set[int] = set()

    def choose(w: str, at: int, hashed: list[int]) -> str | None:
        return choice(options[w], hashed[max(0, at - WINDOW) : at] + hashed[at + 1 : at + 1 + WINDOW], space) if w in options else None

    kept = [(n, x) for n, x in enumerate(lines, 1) if n not in marks and x.strip() != _LABEL]
    for at, ((n, line), (tokens, divided)) in enumerate(zip(kept, line_tokens([x for _, x in kept]))):
        after = next((x for _, x in kept[at + 1 :] if x.strip()), None)
        divided = divided and (after is None or after.lstrip()[:1].isalpha())
        if divided:
            noises.append((n, "broken_word"))
        hashed = [xxhash.xxh32_intdigest(shape(t)[1]) % CONTEXTS for t in tokens]
        out = []
        for i, t in enumerate(tokens):
            tail = t[-1] if divided and i == len(tokens) - 1 else ""
            u = t[: len(t) - len(tail)] if tail else t
            v = fix_numbers(drop_strays(u))
            if carried and i == 0:  # the word began in the line before
                n0, head = carried
                before, w = shape(head + v)
                new = choose(w, i, hashed)
                if new is not None and len(new) == len(w):
                    cut = len(head) - len(before) + (1 if before else 0)
                    if new[:cut] != w[:cut]:
                        bad.add(n0)
                        body[-1] = body[-1][: len(body[-1]) - len(head)] + (before + new[1:] if before else new)[: len(head)]
                        fixed_words += 1
                    if new[cut:] != w[cut:]:
                        v = v.replace(w[cut:], new[cut:], 1)
            elif not tail:
                before, w = shape(v)
                new = choose(w, i, hashed)
                if new is not None:
                    v = v.replace(before + w[1:] if before else w, before + new[1:] if before else new, 1)
            if v != u:
                bad.add(n)
                fixed_words += 1
            if v:
                out.append(v)
        body.append(" ".join(out))
        joins.append(divided)
        carried = (n, out[-1]) if divided and out else (carried if not tokens else None)
    noises += [(n, "misread") for n in bad]
    return noises, reflow(body, joins), fixed_words


_NEW = re.compile(r"^\s*(?:[-·※▶○●■□◦•*]\s|제\s*\d+\s*[조장절항]|\[?\d+[.)\]]\s|[가-하][.)]\s)")


def reflow(lines: list[str], joins: list[bool]) -> str:
    """Lines as paragraphs: divided words joined, a new paragraph after a blank line, at list items
    and headings, and after a short line that ends a sentence."""
    width = max((len(x) for x in lines), default=0)
    out: list[str] = []
    join, end = False, True
    for s, j in zip(lines, joins):
        if not s.strip():
            end = True
            continue
        if join and out:
            out[-1] += s.lstrip()
        elif end or not out or _NEW.match(s):
            out.append(s.strip())
        else:
            out[-1] += " " + s.strip()
        join = j
        end = not j and ((s.rstrip().endswith((".", "!", "?")) and len(s) < 0.55 * width) or (_NEW.match(s) is not None and len(s) < 0.55 * width))
    return "\n\n".join(out)


def repaired(images: DataFrame) -> DataFrame:
    """(field_name, record_id, doc_id, text, n_corrected, noises) of every scanned page with text.

    An empty text stays empty. noises holds (line_no, noise) in the stored text; the label line of
    combined_context is dropped and is no noise.
    """
    p = materialize(pages(images), "pages")
    marks = materialize(furniture(p), "furniture")
    by_page = marks.groupBy("record_id").agg(F.collect_list(F.struct("line_no", "noise")).alias("marks"))  # a few lines per page
    words = materialize(words_of(p), "words")
    counts = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "counts")
    pairs = materialize(corrections(counts, learn_edits(counts)), "corrections")
    rows = materialize(context_rows(words), "contexts")
    found_space = skip_gram_space(rows)
    options = materialize(competitors(pairs, rows, found_space), "competitors")
    space = images.sparkSession.sparkContext.broadcast(found_space)  # of fixed size
    mine = words.select("record_id", "word").distinct().join(options, "word").groupBy("record_id").agg(F.collect_list(F.struct("word", "n", "context", "options")).alias("fixes"))  # a page's own words

    def run(it):
        for batch in it:
            rows = []
            for f, r, d, t, m, x in zip(*(batch.column(i).to_pylist() for i in range(6))):
                opts = {o["word"]: o for o in x or ()}
                noises, out, n = repair_page(t, {y["line_no"]: y["noise"] for y in m or ()}, opts, space.value)
                rows.append((f, r, d, out, n, [{"line_no": a, "noise": b} for a, b in sorted(noises)]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("line_no", pa.int32()), ("noise", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["field_name", "record_id", "doc_id", "text", "n_corrected", "noises"])

    whole = p.join(by_page, "record_id", "left").join(mine, "record_id", "left").select("field_name", "record_id", "doc_id", "text", "marks", "fixes")
    return whole.mapInArrow(run, "field_name string, record_id long, doc_id string, text string, n_corrected int, noises array<struct<line_no:int,noise:string>>")


def found(images: DataFrame) -> DataFrame:
    """(field_name, record_id, line_no, noise) of all noisy lines."""
    return repaired(images).select("field_name", "record_id", F.explode("noises").alias("x")).select("field_name", "record_id", "x.line_no", "x.noise").distinct()
