"""Problem 6: variant spellings of names typed by people.

Names are brought to one string form (keyboard layout undone, spaces and marks dropped, Hangul as
single letters). Where names parse exactly as a place with a kind of organisation that is listed here,
the lists help: they give the places (a place next to a far better supported one is a misspelling of
it), every place and kind gives the surface forms it may be typed as, and a name is linked to the
nearest form within a radius. All other names, of organisations of any kind and of persons, are linked
with each other: within a radius that grows with their length, in any order of their words, without
words of legal form, and with initials or shortened words; each points to the nearest better supported
spelling, and what hangs together is one agency.

Method of the radius joins: metric-space partitioning under the true edit metric (Levenshtein).
Strings go to the cell of their nearest pivot and, in it, to the ring of their distance from the pivot; a
name goes to every cell and ring that the triangle inequality leaves possible: cells whose pivot is at
most twice the radius farther than its nearest one and within the cell's extent and the radius, rings
within the radius of its own distance. That is complete, and inside the rings the join is exact.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .components import connected_components
from .fold import unify

RADIUS, PIVOTS = 2, 64
#: A spelling with that many documents or questions is no slip of another, unless the other has RATIO times as many.
SUPPORTED, RATIO = 5, 5

# Kinds of organisations, the short forms that people use, and the English name.
KINDS = {
    "시청": (("시청", "시"), "cityhall"),
    "군청": (("군청", "군"), "countyoffice"),
    "대학교": (("대학교", "대학", "대"), "university"),
    "산학협력단": (("대학교산학협력단", "대산학협력단", "대학산학협력단", "대학교산단", "대산단", "산학협력단"), "univindustrycooperationgroup"),
    "시설관리공단": (("시설관리공단", "시설공단", "시관공"), "facilitiescorp"),
    "도시개발공사": (("도시개발공사", "개발공사", "도개공"), "urbandevelopmentcorporation"),
    "산업진흥원": (("산업진흥원", "진흥원", "산진원"), "industrypromotionagency"),
    "교육지원청": (("교육지원청", "교육청", "지원청"), "officeofeducation"),
    "문화재단": (("문화재단", "문재"), "culturalfoundation"),
    "의료원": (("의료원", "병원"), "medicalcenter"),
    "연구원": (("연구원", "연"), "institute"),
    "소프트": (("소프트", "sw"), "softcoltd"),
}
# Words of legal form before or after the name, by kind.
FORMS = {"문화재단": ("재단법인",), "소프트": ("주식회사",), "연구원": ("한국",)}
# The two-set keyboard, and the romanisation of syllables by initial, medial and final.
KEYS = dict(zip("rRseEfaqQtTdwWczxvgkoiOjpuPhynbml", "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎㅏㅐㅑㅒㅓㅔㅕㅖㅗㅛㅜㅠㅡㅣ"))
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = ["ㅏ", "ㅐ", "ㅑ", "ㅒ", "ㅓ", "ㅔ", "ㅕ", "ㅖ", "ㅗ", "ㅗㅏ", "ㅗㅐ", "ㅗㅣ", "ㅛ", "ㅜ", "ㅜㅓ", "ㅜㅔ", "ㅜㅣ", "ㅠ", "ㅡ", "ㅡㅣ", "ㅣ"]
FINALS = ["", "ㄱ", "ㄲ", "ㄱㅅ", "ㄴ", "ㄴㅈ", "ㄴㅎ", "ㄷ", "ㄹ", "ㄹㄱ", "ㄹㅁ", "ㄹㅂ", "ㄹㅅ", "ㄹㅌ", "ㄹㅍ", "ㄹㅎ", "ㅁ", "ㅂ", "ㅂㅅ", "ㅅ", "ㅆ", "ㅇ", "ㅈ", "ㅊ", "ㅋ", "ㅌ", "ㅍ", "ㅎ"]
ROMAN_INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
ROMAN_MEDIALS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
ROMAN_FINALS = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
# Words of legal form, which say nothing about whose name it is, and short forms of given names.
LEGAL = frozenset("주식회사 유한회사 합자회사 재단법인 사단법인 co company corp corporation inc incorporated limited llc ltd the of and for".split())
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bill": "william", "will": "william", "jim": "james", "mike": "michael", "dave": "david", "dan": "daniel", "tom": "thomas", "joe": "joseph",
    "sam": "samuel", "ben": "benjamin", "chris": "christopher", "matt": "matthew", "tony": "anthony", "steve": "steven", "liz": "elizabeth", "kate": "katherine", "sue": "susan", "peggy": "margaret",
}
_KOREAN = re.compile(r"[가-힣]")


def parts(c: str) -> tuple[int, int, int]:
    """Numbers of the initial, medial and final of a syllable."""
    n = ord(c) - 0xAC00
    return n // 588, n % 588 // 28, n % 28


def to_letters(s: str) -> str:
    """Hangul syllables as single letters; double vowels and final clusters are two letters."""
    out = []
    for c in s:
        if "가" <= c <= "힣":
            i, m, f = parts(c)
            out.append(INITIALS[i] + MEDIALS[m] + FINALS[f])
        else:
            out.append(c)
    return "".join(out)


def romanize(s: str) -> str:
    """Syllable by syllable, without separators."""
    return "".join(ROMAN_INITIALS[i] + ROMAN_MEDIALS[m] + ROMAN_FINALS[f] for i, m, f in map(parts, s))


def from_keyboard(s: str) -> str | None:
    """Hangul typed with the keyboard in Latin mode; None if the keys don't give whole syllables."""
    if not re.fullmatch(r"[A-Za-z ]{4,}", s):
        return None
    keys = [KEYS.get(c) or KEYS.get(c.lower()) or c for c in s]
    out, i = [], 0
    vowel = lambda k: k < len(keys) and "ㅏ" <= keys[k] <= "ㅣ"
    while i < len(keys):
        if keys[i] == " ":
            out.append(" ")
            i += 1
            continue
        if keys[i] not in INITIALS or not vowel(i + 1):
            return None
        ini, med, i = INITIALS.index(keys[i]), keys[i + 1], i + 2
        if vowel(i) and med + keys[i] in MEDIALS:
            med += keys[i]
            i += 1
        fin = ""
        while i < len(keys) and not vowel(i) and keys[i] != " " and not vowel(i + 1) and fin + keys[i] in FINALS:
            fin += keys[i]
            i += 1
        out.append(chr(0xAC00 + ini * 588 + MEDIALS.index(med) * 28 + FINALS.index(fin)))
    return "".join(out)


def normal(name: str) -> str:
    """One string form: look-alikes unified, keyboard layout undone, only letters and digits, lower case."""
    s = unicodedata.normalize("NFKC", unify(name)).strip()
    s = from_keyboard(s) or re.sub(r"\(재+\)", "재단법인", re.sub(r"\(주+\)", "주식회사", s))
    return "".join(filter(str.isalnum, s)).lower()


def surface_forms(place: str, kind: str) -> set[str]:
    """What an organisation of a kind in a place may be written as, in normal form."""
    aliases, english = KINDS[kind]
    out = {place + a for a in aliases} | {aliases[0] + place}
    if kind == "산학협력단":
        out = {place + a for a in aliases} | {"산학협력단" + place + "대학교", "산학협력단" + place + "대"}
    for f in FORMS.get(kind, ()):
        out |= {f + place + a for a in aliases} | {place + a + f for a in aliases} | {place + f + a for a in aliases}
        out |= {a + f + place for a in aliases}
    if _KOREAN.search(place):
        r = romanize(place)
        out |= {("korea" if kind == "연구원" else "") + r + english, r + english}
    return out


_EXACT = [(a, k) for k, (aliases, _) in KINDS.items() for a in aliases]
_EXACT.sort(key=lambda x: -len(x[0]))


def parse(s: str) -> tuple[str, str] | None:
    """(place, kind) of a normal form that is exactly a surface form of them; longest kind first."""
    if not _KOREAN.search(s):
        return None
    for a, k in _EXACT:
        for p in ([s[: -len(a)]] if s.endswith(a) else []) + ([s[len(a) :]] if s.startswith(a) else []):
            for f in ("", *FORMS.get(k, ())):
                q = p.removeprefix(f) if f else p
                if 2 <= len(q) <= 5 and re.fullmatch("[가-힣]+", q) and s in surface_forms(q, k) and not any(q.startswith(x) or q.endswith(x) for x in FORMS.get(k, ()) if len(x) > 1):
                    if k == "연구원" and not f and q.startswith("한국"):
                        continue
                    return q, k
    return None


def slips(s: str) -> list[str]:
    """The name with one typing slip of whole syllables undone: a doubled one, or two that changed places."""
    out = []
    if _KOREAN.search(s):
        for i in range(1, len(s)):
            out.append(s[:i] + s[i + 1 :] if s[i] == s[i - 1] else s[: i - 1] + s[i] + s[i - 1] + s[i + 1 :])
    return out


def variants(s: str) -> list[tuple[str, int]]:
    """(letters, cost): the name itself, and with one slip undone."""
    out = {to_letters(s): 0}
    for v in slips(s):
        out.setdefault(to_letters(v), 1)
    return sorted(out.items())


def words_of(name: str) -> list[str]:
    """The words of a name, without those of legal form where others are left, given names in full."""
    s = unicodedata.normalize("NFKC", unify(name)).lower()
    s = re.sub(r"\(재+\)", " 재단법인 ", re.sub(r"\(주+\)", " 주식회사 ", re.sub(r"\(사+\)", " 사단법인 ", s)))
    words = ["".join(filter(str.isalnum, w)) for w in re.split(r"[\s,/&·]+", re.sub(r"(주식회사|유한회사|재단법인|사단법인)", r" \1 ", s))]
    words = [w for w in words if w]
    return [NICKNAMES.get(w, w) for w in words if w not in LEGAL] or words


def free_forms(name: str) -> list[tuple[str, str]]:
    """(kind, string) of a name of no listed kind: 'near' strings (as typed, and words sorted) may differ by edits,
    'short' ones (initials, initial and last name) stand for the name if they are typed as such, and 'start' ones
    gather names whose words begin alike."""
    w = words_of(name)
    out = {("words", " ".join(sorted(w))), ("near", to_letters("".join(w))), ("near", to_letters("".join(sorted(w)))), ("near", to_letters(normal(name)))}
    if len(w) > 1 and all(x.isascii() for x in w):
        out |= {("short", w[0][0] + w[-1]), ("short", w[-1] + w[0][0])}
        if len(w) > 2:
            out.add(("short", "".join(x[0] for x in w)))
        if all(len(x) >= 3 for x in w):
            out.add(("start", " ".join(x[:3] for x in w)))
    return sorted(x for x in out if x[1])


def shortened(a: str, b: str) -> bool:
    """Whether two names are the same word by word, but for words of one that only begin those of the other."""
    x, y = words_of(a), words_of(b)
    return len(x) == len(y) and all(p.startswith(q) or q.startswith(p) for p, q in zip(x, y)) and (all(len(p) <= len(q) for p, q in zip(x, y)) or all(len(p) >= len(q) for p, q in zip(x, y)))


def radius_join(left: DataFrame, right: DataFrame, radius: int, pivots: int | None = None) -> DataFrame:
    """(left key, right key, distance) of all pairs of strings within the radius of the edit metric.

    Both sides have the columns key and s. Complete: see the module's text. The pivots are strings of
    the right side, those of least hash; without a number, the root of the number of its strings.
    """
    spark = left.sparkSession
    near, cells = ring_sides(left, right, radius, pivots)
    both = near.repartition(2 * spark.sparkContext.defaultParallelism, "cell", "ring").join(cells, ["cell", "ring"]).where(F.abs(F.length("ls") - F.length("rs")) <= radius)
    return both.withColumn("distance", F.levenshtein("ls", "rs", radius)).where("distance >= 0").select("lk", "rk", "distance")


def ring_sides(left: DataFrame, right: DataFrame, radius: int, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two sides of a radius join: (lk, ls, cell, ring), a row for each ring to look into, and (rk, rs, cell,
    ring), one row each."""
    spark = left.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    strings = right.select("s").distinct()
    if pivots is None:
        pivots = int(max(PIVOTS, strings.count() ** 0.5))
    chosen = [r.s for r in strings.orderBy(F.xxhash64("s"), "s").limit(pivots).collect()] or [""]  # the root of the number of names
    one = spark.createDataFrame([(chosen,)], "pivots array<string>")
    measured = lambda d: d.repartition(tasks, "s").crossJoin(F.broadcast(one)).withColumn("d", F.transform("pivots", lambda p: F.levenshtein(F.col("s"), p))).withColumn("least", F.array_min("d")).drop("pivots")  # one row
    cells = materialize(measured(right).select(F.col("key").alias("rk"), F.col("s").alias("rs"), F.array_position("d", F.col("least")).cast("int").alias("cell"), F.col("least").alias("ring")), "cells")
    reach = {r.cell: r.reach for r in cells.groupBy("cell").agg(F.max("ring").alias("reach")).collect()}  # a row per pivot
    extent = spark.createDataFrame([([reach.get(i + 1, -1) for i in range(len(chosen))],)], "reach array<int>")
    possible = lambda i: (F.element_at("reach", i) >= 0) & (F.element_at("d", i) <= F.col("least") + 2 * radius) & (F.element_at("d", i) <= F.element_at("reach", i) + radius)
    near = measured(left).crossJoin(F.broadcast(extent)).withColumn("cell", F.explode(F.filter(F.sequence(F.lit(1), F.lit(len(chosen))), possible)))  # one row
    at = F.element_at("d", F.col("cell"))
    rings = F.sequence(F.greatest(F.lit(0), at - radius), F.least(at + radius, F.element_at("reach", F.col("cell"))))
    return near.select(F.col("key").alias("lk"), F.col("s").alias("ls"), "cell", F.explode(rings).alias("ring")), cells


def observed_names(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(name, n): the agencies in chunk metadata and in the filters of questions, as stored, with the
    number of documents and questions that have them. Null and blank names are left out."""
    a = chunks.select(F.col("metadata")["agency"].alias("name"), F.col("doc_id").alias("at")).distinct()
    b = questions.select(F.col("filters")["agency"].alias("name"), F.col("question_id").alias("at")).distinct()
    return a.union(b).where(F.col("name").rlike(r"(?U)\S")).groupBy("name").agg(F.count("*").alias("n"))


def link(names: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(name, agency, cost) of (name, n): the agency that a spelling belongs to, as place and kind or, for names
    of no listed kind, as the best supported spelling.

    A name that is near to no other, or equally near to different agencies, is an agency of its own and
    has a null cost. Of equally supported spellings the one that sorts first stands for all.
    """
    seen = materialize(names, "names")
    listed = materialize(link_listed(seen, radius), "listed")
    free = link_free(seen, listed)
    pick = F.coalesce("to_agency", "agency", "name")
    return listed.join(free, "name", "left").select("name", pick.alias("agency"), F.coalesce("cost", "free_cost").alias("cost"))


def link_free(seen: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, to_agency, free_cost) of the names that no list knows and that hang together with others."""

    def forms(it):
        for batch in it:
            rows = [(x, k, v) for x in batch.column(0).to_pylist() for k, v in free_forms(x)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "kind", "s"])

    f = materialize(seen.select("name").mapInArrow(forms, "key string, kind string, s string"), "free_forms")
    alone = listed.where("cost is null").select(F.col("name").alias("key"))
    kind = lambda k: f.where(F.col("kind") == k).select("key", "s")
    mine = lambda k: kind(k).join(alone, "key", "left_semi")
    # one letter in six may differ, two in twelve
    size = F.least(F.length("ls"), F.length("rs"))
    near, cells = ring_sides(mine("near"), kind("near"), 2)
    both = near.join(cells, ["cell", "ring"]).where("lk <> rk").withColumn("distance", F.levenshtein("ls", "rs", 2))
    edits = both.where((F.col("distance") >= 0) & (F.col("distance") * 6 <= size)).select(F.col("lk").alias("a"), F.col("rk").alias("b"), F.col("distance").alias("free_cost"))
    short = mine("near").alias("x").join(kind("short").alias("y"), F.col("x.s") == F.col("y.s")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).where("a <> b").distinct()

    def sole(pairs: DataFrame) -> DataFrame:
        """The pairs whose first name has partners of one set of words only: initials of several names tell nothing."""
        of = kind("words").select(F.col("key").alias("b"), "s")
        one = pairs.join(of, "b").groupBy("a").agg(F.count_distinct("s").alias("k")).where("k = 1").select("a")
        return pairs.join(one, "a").select("a", "b", F.lit(1).alias("free_cost"))

    short = sole(short)

    def check(it):
        for batch in it:
            yield batch.filter(pa.array([shortened(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_()))

    # names of one beginning: the shorter one looks for what it begins
    start = mine("start").alias("x").join(kind("start").alias("y"), (F.col("x.s") == F.col("y.s")) & (F.length("x.key") < F.length("y.key"))).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    start = sole(start.mapInArrow(check, "a string, b string"))
    edges = materialize(edits.union(short).union(start).groupBy("a", "b").agg(F.min("free_cost").alias("free_cost")), "name_edges")
    n = seen.select("name", "n")
    e = edges.join(n.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    # two well supported names that differ are two agencies; else the worse supported one points to the nearest
    e = e.where((F.col("free_cost") == 0) | (F.least("na", "nb") < SUPPORTED) | (F.greatest("na", "nb") >= RATIO * F.least("na", "nb")))
    both_ways = e.select("a", "b", "free_cost", "na", "nb").union(e.select("b", "a", "free_cost", "nb", "na"))
    up = both_ways.where((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))).join(alone.withColumnRenamed("key", "a"), "a", "left_semi")
    to = materialize(up.groupBy("a").agg(F.min(F.struct("free_cost", (-F.col("nb")).alias("r"), "b")).alias("x")).select("a", "x.b", "x.free_cost"), "name_links")
    comp = connected_components(to.select("a", "b")).withColumnRenamed("node", "name")
    known = comp.join(seen, "name").join(listed.select("name", F.when(F.col("cost").isNotNull(), F.col("agency")).alias("listed_as")), "name")
    # the agency of a component is that of its members that the lists know, else its best supported spelling
    best = known.groupBy("component").agg(F.coalesce(F.max_by("listed_as", F.when(F.col("listed_as").isNotNull(), F.col("n"))), F.min_by("name", F.struct(-F.col("n"), F.col("name")))).alias("to_agency"))
    own = comp.join(best, "component").join(alone.withColumnRenamed("key", "name"), "name", "left_semi")
    return own.join(to.select(F.col("a").alias("name"), "free_cost"), "name", "left").select("name", "to_agency", F.coalesce("free_cost", F.lit(0)).alias("free_cost"))


def link_listed(seen: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(name, agency, cost) of (name, n) for names of the kinds listed here; others have a null agency and cost."""

    def prepare(it):
        for batch in it:
            rows = []
            for name in batch.column(0).to_pylist():
                s = normal(name)
                place, kind = parse(s) or (None, None)
                other = sorted({x[0] for v in slips(s) if (x := parse(v))} - {place}) if place else []
                if place and len(place) > 3:  # the rest may be misspelled: the head of a longer kind, or a word of legal form
                    other += [place[:k] for k in range(2, len(place))] + [place[k:] for k in range(1, len(place) - 1)]
                rows.append((name, place, kind, [{"s": v, "cost": c} for v, c in variants(s)] if s else [], other))
            cols = list(zip(*rows)) or [()] * 5
            t = pa.list_(pa.struct([("s", pa.string()), ("cost", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], t), pa.array(cols[4], pa.list_(pa.string()))], names=["name", "place", "kind", "forms", "others"])

    known = materialize(seen.select("name").mapInArrow(prepare, "name string, place string, kind string, forms array<struct<s:string,cost:int>>, others array<string>").join(seen, "name"), "parsed")
    places = known.where("place is not null").groupBy("place").agg(F.count("*").alias("n_names"), F.sum("n").alias("n"))

    def letters(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_letters(x) for x in batch.column(0).to_pylist()], pa.string())], names=["key", "s"])

    # places that have no better supported place within one letter or one slip
    p = places.select("place").mapInArrow(letters, "key string, s string")
    near = radius_join(p, p, 1).where("lk <> rk").select("lk", "rk").union(known.where("place is not null").select(F.col("place").alias("lk"), F.explode("others").alias("rk"))).distinct()
    x, y = places.alias("x"), places.alias("y")
    rank = lambda t: F.struct(f"{t}.n_names", f"{t}.n", f"{t}.place")
    slip = (F.col("x.n_names") < 4) | (F.col("x.n") < SUPPORTED) | (F.col("y.n_names") >= 3 * F.col("x.n_names")) | (F.col("y.n") >= 3 * F.col("x.n"))
    worse = near.join(x, F.col("lk") == F.col("x.place")).join(y, F.col("rk") == F.col("y.place")).where((rank("x") < rank("y")) & slip).select(F.col("lk").alias("place")).distinct()
    good = places.join(worse, "place", "left_anti").select("place")

    def forms(it):
        for batch in it:
            rows = sorted({(f"{p}|{k}", to_letters(f)) for p in batch.column(0).to_pylist() for k in KINDS for f in surface_forms(p, k)})
            cols = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())], names=["key", "s"])

    targets = materialize(good.mapInArrow(forms, "key string, s string").distinct(), "forms")
    typed = known.select("name", F.explode("forms").alias("f")).select(F.struct("name", "f.cost").alias("key"), F.col("f.s").alias("s"))
    hits = radius_join(typed, targets, radius).select("lk.name", F.col("rk").alias("agency"), (F.col("lk.cost") + F.col("distance")).alias("cost")).where(F.col("cost") <= radius)
    best = hits.groupBy("name", "agency").agg(F.min("cost").alias("cost"))
    least = best.groupBy("name").agg(F.min("cost").alias("cost"))
    one = best.join(least, ["name", "cost"]).groupBy("name", "cost").agg(F.min("agency").alias("agency"), F.count("*").alias("k")).where("k = 1")
    return seen.select("name").join(one, "name", "left").select("name", "agency", "cost")


def found(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(name_a, name_b): different spellings of one agency."""
    m = materialize(link(observed_names(chunks, questions)), "links")
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, (F.col("a.agency") == F.col("b.agency")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
