"""Problem 10: abusive, hateful or sexual content.

Method: a counterfactual-regularised classifier of sentences. In labelled sentences the words for
groups of people are swapped for those of other groups, and changes of the score are penalised, so
that the score rests on what is said and not on whom it names; neutral mentions of a group are then
no longer taken for abuse. A document's labels say nothing about which sentence earned them: the
training alternates between picking the sentences that carry a label and fitting the model.

The features are hashed substrings of letters only, so that spaces, marks and digits put between
letters and repeated letters change little. Everything is fitted here, from at most LABELLED_ROWS
labelled documents and a short list of words; every document is scored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from .fold import ALNUM, batches_by_size, mix, unify

CLASSES = ("clean", "abusive", "hateful", "sexual")
#: The most labelled documents that the model is fitted on; beyond, those of least hash are taken,
#: half of them clean and half of other labels as far as there are so many.
LABELLED_ROWS = 8000
#: The most characters that they hold together: documents of the sample beyond, in the same order, are left out.
LABELLED_CHARS = 48_000_000
SLOTS, ORDERS, SEED = 1 << 20, (2, 3, 4), 11
#: Features in more than this share of all documents are the corpus's own language and no evidence.
COMMON = 0.005
ROUNDS, EPOCHS, RATE, DECAY, SWAP_PENALTY = 4, 6, 0.25, 2e-6, 0.05
#: FOREIGN: before anything is learnt, a sentence carries its document's label if that share of its features is
#: none of the corpus's own.
BIAS, THRESHOLD, FOREIGN = -5.0, 0.12, 0.35

# Words for groups of people, by language; sorted by form only, no statement about any group.
GROUPS = {
    "ko": "여자 여성 남자 남성 노인 노인네 어르신 장애인 외국인 이민자 이주민 난민 성소수자 동성애자 청년 어린이 이주노동자 조선족 무슬림 유대인 흑인 백인 탈북민 다문화가정".split(),
    "en": "women men immigrants migrants refugees foreigners muslims jews christians gays lesbians elderly disabled blacks whites asians africans teenagers veterans".split(),
}
# Words that open the training, by class. They are few, since labels teach the rest.
SEEDS = {
    "abusive": "병신 새끼 쓰레기 같은 놈|멍청한 놈들|꺼져라|죽여 버린다|패 버린다|뇌가 없냐|한심한 새끼|개새끼|미친놈|닥쳐라|worthless idiots|you stupid moron|shut up you idiot|i will beat you|kill yourself|pathetic trash people".split("|"),
    "hateful": "열등한 족속이다|다 쫓아내야 한다|싹 다 없어져야 한다|전부 격리해라|사람 취급하면 안 된다|주제에 맡는다니 구역질이 난다|해충 같은 것들|더럽고 믿을 수 없는 것들|are vermin|are subhuman|should never be allowed|get rid of them all|inferior race|go back to your country".split("|"),
    "sexual": "화끈하게 같이 잘|성인 남녀 만남|엉덩이만 생각나서 흥분|가슴을 만지고 싶다|섹스 하고 싶다|야한 사진 보내|알몸 사진|자위 영상|19금 채팅방|조건 만남|hot sex tonight|naked pictures|send nudes|touch your breasts|horny singles|want to sleep with you".split("|"),
}
_GROUP = re.compile("|".join(sorted(GROUPS["ko"], key=len, reverse=True)) + r"|\b(?:" + "|".join(GROUPS["en"]) + r")\b", re.I)

_LOWER = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
_LETTER = ALNUM.copy()
_LETTER[ord("0") : ord("9") + 1] = False
_LETTER[0x3131:0x318F] = False  # single Hangul letters stand between syllables as noise
_LATIN = np.zeros(0x110000, bool)
_LATIN[ord("a") : ord("z") + 1] = True
_LEET = np.zeros(128, np.uint32)
_LEET[[ord(c) for c in "013457"]] = [ord(c) for c in "oieast"]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number of each sentence, sentence number of each feature, slot of each feature)."""
    texts = [unify(t) for t in texts]
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    # every text is closed by a line end, so that it has a sentence even if it is empty
    cp = _LOWER[np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.repeat(np.arange(len(texts)), lens)
    line = cp == 10
    stop = (cp == 46) | (cp == 33) | (cp == 63) | (cp == 0x3002)
    space = line | (cp == 32) | (cp == 9) | (cp == 13)
    cut = line.copy()
    cut[1:] |= stop[:-1] & space[1:]
    sid = np.cumsum(cut) - cut  # a separator belongs to the sentence before it
    n = int(sid[-1]) + 1
    sentence_doc = np.zeros(n, np.int64)
    sentence_doc[sid[::-1]] = doc[::-1]
    small = np.minimum(cp, 127).astype(np.int64)
    near = np.zeros(len(cp), bool)
    lat = _LATIN[cp]
    near[1:] |= lat[:-1]
    near[:-1] |= lat[1:]
    # digits that stand for letters, as in "th0s3": next to a letter, or next to such a digit
    digit = (_LEET[small] > 0) & (cp < 128)
    leet = digit & near
    cp = np.where(leet, _LEET[small], cp)
    keep = _LETTER[cp]
    c, s = cp[keep].astype(np.uint64), sid[keep]
    fresh = np.ones(len(c), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    c, s = c[fresh], s[fresh]
    rows, slots = [], []
    with np.errstate(over="ignore"):
        h, prev = c + np.uint64(7), 1
        for k in ORDERS:
            for _ in range(k - prev):
                m = len(h) - 1
                if m <= 0:
                    break
                h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[len(c) - m :]
            prev = k
            m = len(c) - k + 1
            if m <= 0:
                break
            ok = s[:m] == s[k - 1 :]
            rows.append(s[:m][ok])
            slots.append((mix(h[:m][ok] + np.uint64(k)) % np.uint64(SLOTS)).astype(np.int64))
    if not rows:
        return sentence_doc, np.empty(0, np.int64), np.empty(0, np.int64)
    return sentence_doc, np.concatenate(rows), np.concatenate(slots)


def logits(n: int, rows: np.ndarray, slots: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores of n sentences for the classes but clean, whose score is 0."""
    out = np.empty((n, weights.shape[1]), np.float64)
    w = weights[slots]
    for c in range(weights.shape[1]):
        out[:, c] = np.bincount(rows, weights=w[:, c], minlength=n) + bias[c]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.concatenate([np.zeros((len(z), 1)), z], axis=1)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Sentences:
    """Sentences as rows of sparse features that can be picked."""

    def __init__(self, n: int, rows: np.ndarray, slots: np.ndarray):
        o = np.argsort(rows, kind="stable")
        self.n, self.slots = n, slots[o]
        self.at = np.searchsorted(rows[o], np.arange(n + 1))

    def pick(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `which`, slot) of the features of some sentences."""
        size = self.at[which + 1] - self.at[which]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[which], size)
        return np.repeat(np.arange(len(which)), size), self.slots[at]

    def score(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(self.n), np.diff(self.at))
        return softmax(logits(self.n, rows, self.slots, w, b))


def fit(x: Sentences, which: np.ndarray, y: np.ndarray, swapped: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a softmax over the sentences `which` with classes y; swapped holds pairs of
    sentences that differ in the group they name and must score alike. Weights are evidence for a
    class and never negative: the ordinary words around an insult don't excuse it."""
    rng = np.random.default_rng(seed)
    k = len(CLASSES) - 1
    w, g2 = np.zeros((SLOTS, k), np.float32), np.full((SLOTS, k), 1e-3, np.float32)
    b = np.full(k, BIAS)
    share = np.bincount(y, minlength=k + 1)
    weight = np.sqrt(share.max() / np.maximum(share, 1))[y]
    for _ in range(EPOCHS):
        order = rng.permutation(len(which))
        for lo in range(0, len(order), 512):
            o = order[lo : lo + 512]
            rows, slots = x.pick(which[o])
            d = softmax(logits(len(o), rows, slots, w, b))
            d[np.arange(len(o)), y[o]] -= 1
            d = d[:, 1:] * weight[o][:, None] / 8
            grads, places = [d[rows]], [slots]
            if len(swapped):
                p = swapped[rng.integers(0, len(swapped), 64)]
                r0, s0 = x.pick(p[:, 0])
                r1, s1 = x.pick(p[:, 1])
                gap = SWAP_PENALTY * (logits(len(p), r0, s0, w, b) - logits(len(p), r1, s1, w, b)) / 8
                grads += [gap[r0], -gap[r1]]
                places += [s0, s1]
            at, inv = np.unique(np.concatenate(places), return_inverse=True)
            g = np.concatenate(grads)
            g = np.stack([np.bincount(inv, weights=g[:, c], minlength=len(at)) for c in range(k)], axis=1) + DECAY * w[at]
            g2[at] += g * g
            w[at] = np.maximum(w[at] - RATE * g / np.sqrt(g2[at]), 0)
    return w, b


def swap_groups(sentence: str, rng) -> str | None:
    """The sentence with each word for a group replaced by another of its language; None without any."""
    if not _GROUP.search(sentence):
        return None

    def other(m: re.Match) -> str:
        words = GROUPS["en" if m.group().isascii() else "ko"]
        return words[rng.integers(len(words))]

    return _GROUP.sub(other, sentence)


_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n")


def common_slots(documents: DataFrame, share: float = COMMON) -> np.ndarray:
    """The share of all documents that a slot occurs in, where that exceeds `share`; else 0.

    A task reports every slot that it has seen with its number of documents, SLOTS rows at most, so that
    the sums are exact however the rows fall into tasks; only the sums are held against the share.
    """

    def run(it):
        count, n = np.zeros(SLOTS, np.int64), 0
        for batch in it:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for lo, hi in batches_by_size(texts, 400_000):
                of, r, s = features(texts[lo:hi])
                seen = np.sort(of[r] * SLOTS + s)
                count += np.bincount(seen[np.concatenate([[True], seen[1:] != seen[:-1]])] % SLOTS, minlength=SLOTS) if len(seen) else 0
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(count[at], n))], names=["slot", "n"])

    sums = documents.where("text is not null").select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = sums.where("slot = -1 or n > 3").toPandas()  # SLOTS rows and one at most
    total = got.loc[got.slot == -1, "n"].sum()
    got = got[(got.slot >= 0) & (got.n > share * total)]
    common = np.zeros(SLOTS)
    common[got.slot.to_numpy(np.int64)] = got["n"].to_numpy(float) / max(1, total)
    return common


def evidence_free(labelled: list[tuple[str, str]], common: np.ndarray) -> np.ndarray:
    """Which slots are the corpus's own language: common ones, but for those that labelled documents show
    to be content of the bad kind, which may be common as well."""
    count = np.zeros((2, SLOTS), np.int64)
    texts = [t for t, _ in labelled]
    bad = np.array([c != "clean" for _, c in labelled], bool)
    for lo, hi in batches_by_size(texts, 400_000):
        of, r, s = features(texts[lo:hi])
        seen = np.unique(of[r] * SLOTS + s)
        for k in (0, 1):
            count[k] += np.bincount(seen[bad[lo:hi][seen // SLOTS] == bool(k)] % SLOTS, minlength=SLOTS)
    clean_share = count[0] / max(1, (~bad).sum())
    return (common > 0) & ~((count[1] >= 3) & (clean_share < 0.2 * common))


def train(labelled: list[tuple[str, str]], common: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights from (text, label) of documents and the shares of common slots, by alternating between
    sentences and model."""
    rng = np.random.default_rng(seed)
    common = evidence_free(labelled, common)
    y_doc = np.array([CLASSES.index(c) for _, c in labelled] or [0])
    sentences, doc = [], []
    for i, (t, _) in enumerate(labelled):
        own = [s for s in _SENTENCE.split(unify(t)) if s.strip()]
        sentences += own
        doc += [i] * len(own)
    doc_of = np.array(doc, np.int64)
    # many clean sentences are alike: those that differ in numbers only are taken once
    seen: set[str] = set()
    keep = []
    for i, s in enumerate(sentences):
        if y_doc[doc_of[i]]:
            keep.append(i)
        elif (k := re.sub(r"\d+", "", s)) not in seen:
            seen.add(k)
            keep.append(i)
    sentences, doc_of = [sentences[i] for i in keep], doc_of[keep] if keep else doc_of
    seeds = [(s, CLASSES.index(c)) for c, many in SEEDS.items() for s in many]
    pairs, extra = [], []
    for i, s in enumerate(sentences):
        if (t := swap_groups(s, rng)) is not None:
            pairs.append((i, len(sentences) + len(seeds) + len(extra)))
            extra.append(t)
    _, rows, slots = features([s.replace("\n", " ").replace(". ", " ").replace("! ", " ").replace("? ", " ") for s in [*sentences, *(s for s, _ in seeds), *extra]])
    n = len(sentences)
    total = np.maximum(np.bincount(rows, minlength=n)[:n], 1)
    rare = ~common[slots]
    x = Sentences(n + len(seeds) + len(extra), rows[rare], slots[rare])
    y_of = y_doc[doc_of] if n else np.empty(0, np.int64)
    seed_at, seed_y = n + np.arange(len(seeds)), np.array([c for _, c in seeds])
    swapped = np.array(pairs, np.int64).reshape(-1, 2)
    bad_docs = np.unique(doc_of[y_of > 0]) if n else np.empty(0, np.int64)

    # at first the sentences that share least with the corpus carry the label
    p_bad = np.where(y_of > 0, np.diff(x.at)[:n] / total, 0.0)
    ignore, other = np.zeros(n, bool), np.zeros(n, bool)
    w = b = None
    for turn in range(ROUNDS):
        y = np.zeros(n, np.int64)
        for d in bad_docs:
            own = np.arange(*np.searchsorted(doc_of, [d, d + 1]))
            top = p_bad[own].max()
            carry = own[p_bad[own] >= max(0.999 * top, 0.5 if turn else FOREIGN)]
            y[carry] = y_doc[d]
            # the others of the document may be bad as well: those in doubt teach neither
            doubt = own[p_bad[own] >= (0.05 if turn else 0)]
            ignore[doubt] = True
            ignore[carry] = turn > 1 and top < 0.1  # nothing in it speaks for the label
            ignore[carry[other[carry] & (turn > 0)]] = True  # what is like it has another label elsewhere
        use = np.flatnonzero(~ignore)
        last = turn == ROUNDS - 1
        if last:
            w, b = fit(x, np.concatenate([use, seed_at]), np.concatenate([y[use], seed_y]), swapped, seed)
            break
        # halves of the documents judge each other, so that a wrong label isn't learnt by heart
        p = np.zeros((n, len(CLASSES)))
        for half in (0, 1):
            own = use[doc_of[use] % 2 == half]
            w, b = fit(x, np.concatenate([own, seed_at]), np.concatenate([y[own], seed_y]), swapped, seed + turn)
            there = doc_of % 2 != half
            p[there] = x.score(w, b)[:n][there]
        p_bad = 1 - p[:, 0]
        likeliest = p[:, 1:].argmax(axis=1) + 1
        other = (likeliest != y_of) & (y_of > 0) & (p[np.arange(n), likeliest] > 2 * p[np.arange(n), y_of]) & (p_bad > 0.5)
        ignore = (y_of == 0) & (p_bad > 0.9)
    return w, b


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, chars: int = LABELLED_CHARS) -> list[tuple[str, str]]:
    """At most `rows` labelled documents as (text, label): the label most reviewers gave, ties to the
    later one in the order of CLASSES; labels that are none of CLASSES are left out.

    Clean documents and others take turns by hash, so that either has half of the sample at least, or
    all of its documents, whatever the number of labels. Texts after the first LABELLED_CHARS characters of
    the sample are left out, so that what the driver holds is bounded."""
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label"))
    votes = labels.where(F.col("label").isin(*CLASSES) & F.col("doc_id").isNotNull()).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    one = votes.groupBy("doc_id").agg(F.max_by("label", F.struct("n", order)).alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sides = [one.where(side).orderBy(*by_hash).limit(rows) for side in (F.col("label") != "clean", F.col("label") == "clean")]
    turn = F.row_number().over(W.partitionBy(F.col("label") == "clean").orderBy(*by_hash))  # over 2 * rows at most
    some = sides[0].union(sides[1]).withColumn("turn", turn).orderBy("turn", F.col("label") == "clean").limit(rows)
    texts = documents.where("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", "text", "label", "turn").dropDuplicates(["doc_id"])
    so_far = F.sum(F.length("text")).over(W.orderBy("turn", F.col("label") == "clean").rowsBetween(W.unboundedPreceding, 0))  # over `rows` at most
    got = materialize(texts, "labelled").withColumn("so_far", so_far).where(F.col("so_far") <= chars).orderBy("doc_id").select("text", "label").collect()
    return [(r.text, r.label) for r in got]


def model(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases fitted on the labelled sample, with the common language of all documents."""
    return train(labelled_sample(documents, labels, rows), common_slots(documents))


_MODELS: dict[str, tuple] = {}


def scores(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, source, score, category, sentence_no) of every document with an id.

    score is the highest probability of a sentence to be abusive, hateful or sexual, category the
    likeliest of these there and sentence_no its number from 1. Null and empty texts score 0 and
    have a null category; a repeated row is returned once.
    """
    spark = documents.sparkSession
    shared, name = spark.sparkContext.broadcast(model(documents, labels, rows)), uuid.uuid4().hex

    def run(it):
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = shared.value
        w, b = _MODELS[name]
        for batch in it:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in batches_by_size(texts, 400_000):
                of, r, s = features(texts[lo:hi])
                p = softmax(logits(len(of), r, s, w, b))
                p[np.bincount(r, minlength=len(of)) == 0] = np.eye(len(CLASSES))[0]
                bad = 1 - p[:, 0]
                order = np.lexsort((-np.arange(len(of)), bad, of))
                last = np.concatenate([of[order][1:] != of[order][:-1], [True]])
                best = order[last]  # one per text: every text has a sentence, if an empty one
                first = np.searchsorted(of, np.arange(hi - lo))
                cat = [CLASSES[c + 1] if q > 0 else None for c, q in zip(p[best, 1:].argmax(axis=1), bad[best])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(bad[best]), pa.array(cat, pa.string()), pa.array((best - first + 1).astype(np.int32))],
                    names=["doc_id", "source", "score", "category", "sentence_no"],
                )

    src = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return src.mapInArrow(run, "doc_id long, source string, score double, category string, sentence_no int").dropDuplicates(["doc_id"])


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_docs, n_flagged, rate, and the flagged by category); documents without source are one group."""
    hit = F.col("score") >= threshold
    by = [F.count_if(hit & (F.col("category") == c)).alias(f"n_{c}") for c in CLASSES[1:]]
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(hit).alias("n_flagged"), F.avg(hit.cast("double")).alias("rate"), *by)


def found(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, category) of the documents that score at least the threshold."""
    return scores(documents, labels).where(F.col("score") >= threshold).select("doc_id", "category")
