import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import fold, leakage, lookalike, mixture, names, qa_pairs, repetition, split

CHUNK = "chunk_id string, doc_id string, text string, metadata map<string,string>, loaded_at timestamp"


def chunks(spark, rows):
    return spark.createDataFrame([(i, "d1", t, {}, None) for i, t in rows], CHUNK)


# -- folding

def test_fold_makes_lookalikes_equal():
    assert fold.fold("ВРR  Ｒéѕeаu​ Ⅱ\xa0차") == "bpr réseau ii 차"
    assert fold.unify("가나") == "가나"
    assert fold.unify("① ㈜") == "① ㈜"  # visibly different from 1 and (주)


@given(st.lists(st.text(max_size=30), max_size=6), st.sampled_from([1, 3, 5, 12]))
def test_grams_are_substrings(texts, k):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    h, d, p = fold.gram_hashes(*fold.code_points(texts), k)
    by = {}
    for x, i, j in zip(h, d, p):
        by.setdefault(texts[i][j : j + k], set()).add(int(x))
    assert len(h) == sum(max(0, len(t) - k + 1) for t in texts)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


# -- splitting

@settings(max_examples=150)
@given(st.text(alphabet="가나다. \n!ab,", min_size=81, max_size=900), st.integers(0, 25))
def test_pieces_cover_the_text(text, overlap):
    pieces = split.split_item("text", text, 80, overlap)
    assert all(len(p) <= 80 for *_, p in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    before = 0
    for k, (a, b, o, _, p) in enumerate(pieces):
        assert text[a - o : b] == p or text[a - o : b].strip() == p
        assert o == (0 if k == 0 else max(0, min(overlap, before, 80 - (b - a))))
        before = b - a
    units = [u.strip() for u in re.split(r"\r?\n|(?<=[.!?])\s+", text)]
    assert all(x[3] for x in pieces) == (max(map(len, units)) <= 80)


def test_natural_cuts_are_kept():
    text = " ".join(f"문장 {i:02d} 은 이렇게 끝난다." for i in range(40))
    pieces = split.split_item("text", text, 120, 20)
    assert all(p[4].rstrip().endswith(".") and p[3] for p in pieces)
    long = "가" * 110 + "."  # fits a piece, but not with the whole overlap
    pieces = split.split_item("text", f"짧은 문장이다. {long} 또 하나. {long} 끝.", 120, 20)
    assert [long in p[4] for p in pieces].count(True) == 2 and all(p[3] for p in pieces)


def test_a_broken_merge_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(split, "merge", lambda *a: [0])
    with pytest.raises(AssertionError):
        split.split_item("text", "문장이다. " * 200)


def test_table_pieces_repeat_the_head():
    table = "| a | b |\r\n|---|---|\r\n" + "\r\n".join(f"| {i} | {'x' * 20} |" for i in range(30))
    pieces = split.split_item("table", table, 200, 40)
    assert all(p.startswith("| a | b |\r\n|---|---|\r\n") and len(p) <= 200 for *_, p in pieces)
    head = len("| a | b |\r\n|---|---|\r\n")
    assert "".join(x[4][head + x[2] :] for x in pieces) == table[head:]
    assert all(p[head:].startswith("| ") for *_, p in pieces)  # whole rows, in the overlap too
    natural = lambda t: all(x[3] for x in split.split_item("table", t))
    assert not natural("| a |\n|---|\n| " + "y" * 900 + " |") and not natural("| " + "h" * 900 + " |\n| x |")
    head = "| " + "h" * 640 + " |\n|---|\n"
    assert natural(head + "| " + "r" * 100 + " |\n| s |\n" * 3) and not natural(head + "| " + "r" * 200 + " |\n" * 3)


def test_split_operator(spark):
    c = chunks(spark, [("a", "가" * 801), ("b", "짧다."), ("b2", None), ("a", "가" * 801), ("c", "문장이다. " * 200)])
    t = spark.createDataFrame([(1, None), (2, "| h |\n|---|\n" + "| row |\n" * 200), (2, "| h |\n|---|\n" + "| row |\n" * 200)], "record_id long, table_markdown string")
    got = {tuple(r) for r in split.found(c, t).collect()}
    assert got == {("text", "a", "forced"), ("text", "c", "natural"), ("table", "2", "natural")}


# -- repetition

def brute_stretch(text, k=12):
    s = "".join(c for c in fold.fold(text) if c.isalnum())
    seen, hit = set(), [False] * len(s)
    for i in range(len(s) - k + 1):
        g = s[i : i + k]
        if g in seen:
            hit[i : i + k] = [True] * k
        seen.add(g)
    return sum(hit) / len(s) if s else 0.0


def test_stretches_match_brute_force():
    rng = random.Random(1)
    texts = ["", "ㄱ", "가나다라마바사아자차카타파하" * 3]
    for _ in range(120):
        a = "".join(rng.choice("가나다라 마1.") for _ in range(rng.randrange(80)))
        texts.append(a + rng.choice(["", a, " x " + a.upper()]))
    assert [round(float(x), 9) for x in repetition.stretch_share([fold.fold(t) for t in texts])] == [round(brute_stretch(t), 9) for t in texts]


def test_ledger_and_policies(spark):
    c = chunks(spark, [("a", "같은 줄이 되풀이된다\n" * 6), ("b", "서로 다른 말만 담은 글이다."), ("c", None), ("d", ""), ("a", "같은 줄이 되풀이된다\n" * 6), ("e", "가" * 50)])
    led = repetition.repetition_ledger(c)
    rows = {r.chunk_id: r for r in led.collect()}
    assert set(rows) == {"a", "b", "d", "e"} and rows["b"].bits == 0 and rows["d"].bits == 0
    assert rows["a"].bits & 0b11 == 0b11 and rows["e"].char_run_share == 1.0
    assert {r.chunk_id for r in repetition.found(c).collect()} == {"a", "e"}
    ab = {(r.policy, r.rule): r for r in repetition.ablations(led).collect()}
    assert ab["found_v1", "stretch_share"].n_failed == 2 and ab["found_v1", "stretch_share"].n_failed_without == 0


# -- look-alikes

def test_lookalikes(spark):
    rows = [
        ("a", "API 규격과 Réseau 시제품"), ("b", "АРІ 규격과 Réѕеаu\xa0시제품"), ("c", "API 규격과 Réseau 시제품"), ("d", "api 규격과 Réseau 시제품"),
        ("e", "Я не РОМА"), ("f", "Я не POMA"), ("g", "가나 다"), ("h", "가나​ 다"), ("i", None), ("j", ""),
    ]
    c = spark.createDataFrame([(i, f"doc{i}", t, {"project_name": "사업 Ⅲ" if i == "a" else "사업 III" if i == "b" else None}, None) for i, t in rows], CHUNK)
    got = {tuple(r) for r in lookalike.found(c).collect()}
    assert got == {("text", "a", "b"), ("text", "b", "c"), ("text", "g", "h"), ("project_name", "doca", "docb")}


def test_repair_asks_the_vocabulary():
    assert lookalike.apply_repairs("ВРR", {"BPR"}) == "BPR"
    assert lookalike.apply_repairs("ВРR", set()) == "ВРR"
    assert lookalike.repaired("слoво", "слoво") == "слово"  # mostly Cyrillic: the Latin letter is the stranger


# -- names

def test_keyboard_and_romanisation():
    assert names.from_keyboard("woeksqjqdls snthwlansghkwoeks") == "재단법인 누소지문화재단"
    assert names.from_keyboard("Seoul City") is None
    assert names.romanize("슬윤숲") == "seulyunsup"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_radius_join_is_complete(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "key int, s string")
    got = {(r.lk, r.rk, r.distance) for r in names.radius_join(df, df, 2, pivots=7).collect()}
    want = {(i, j, n) for i, a in enumerate(words) for j, b in enumerate(words) if (n := lev(a, b)) <= 2}
    assert got == want


def test_names_link(spark):
    spelled = ["찬호로시청", "찬호로 시청", "찬호로싀청", "시청(찬호로)", "CHAN-HO-RO CITY HALL", "찬호로대학교", "찬호로대", "찬호로대학교 산학협력단", "찬호로대 산학협력단", "찬호로군청", "늘희루시청", "늘히루시청", "늘희루교육지원청", None, " "]
    c = spark.createDataFrame([(f"c{i}", f"d{i}", "t", {"agency": n} if n else {}, None) for i, n in enumerate(spelled)], CHUNK)
    q = spark.createDataFrame([("Q1", {"agency": "cksghfhtlcjd"}), ("Q2", None)], "question_id string, filters map<string,string>")
    got = {tuple(r) for r in names.found(c, q).collect()}
    hall = sorted(["찬호로시청", "찬호로 시청", "찬호로싀청", "시청(찬호로)", "CHAN-HO-RO CITY HALL", "cksghfhtlcjd"])
    want = {(a, b) for i, a in enumerate(hall) for b in hall[i + 1 :]} | {("찬호로대", "찬호로대학교"), ("찬호로대 산학협력단", "찬호로대학교 산학협력단"), ("늘희루시청", "늘히루시청")}
    assert got == want


# -- responses

Q = "찬호로 사업의 기숙사 기술 지원은 누가 승인하지?"


@pytest.mark.parametrize("answer,defect", [
    (None, "empty"), ("  ​", "empty"), ("답변:", "empty"), ("N/A", "empty"), ("[1]", "empty"), ("참고 문서: [1] 찬호로시청_사업.hwp", "empty"), ("...", "empty"),
    (Q, "copy"), (f'"{Q}"', "copy"), (f"질문: {Q}", "copy"), (f"질문하신 내용({Q})에 대한 답입니다.\n1. 운영자가 승인한다.", None),
    (Q.replace("승인하지?", "승인하나요.."), "copy"), ("저는 AI 언어 모델이므로 하자보수에 대한 판단을 내릴 수 없습니다.", "refusal"),
    ("죄송하지만 해당 요청에는 답변드릴 수 없습니다.", "refusal"), ("I'm sorry, but I can't help with that request.", "refusal"), ("문서에 해당 항목이 명시되어 있지 않아 확인이 어렵습니다.", None),
    ("El contratista debe revisar OTP cada 16 días y entregar registros antes del cierre. [1]", "other_language"), ("提案者はOTPの試験を7回実施し、報告書を提出しなければなりません。", "other_language"),
    ("UPS·PMO 연계는 REST ERP gateway와 backup-plan 구성을 쓰며 운영자가 승인한다. [2]", None),
    ("- 노인 저장 공간용 그래프는 SAN 규격을 따르고 글자 크기를 26", "truncated"), ("운영자", None), ("17점", None), ("운영자가 승인한다. [2]", None), ("- 운영자가 승인한다 [4]\n\n출처: [4] 찬호로시청.hwp", None),
])
def test_defects(answer, defect):
    assert qa_pairs.classify(Q, answer, False, False) == defect


def test_neighbours_over_ranges(spark):
    texts = [f"{i:03d} 본문" for i in range(60)] + ["017 본문이 더 이어진다.", "033 본", "가"]
    r = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "result_id long, answer_text string")
    got = {x.answer_text for x in qa_pairs.prefix_flags(r).collect() if x.shortened}
    assert got == {t for t in texts if any(u != t and u.startswith(t) for u in texts)}
    assert qa_pairs.prefix_flags(r).count() == len(texts)


# -- leaks

def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("가나다라마바사12") for _ in range(rng.randrange(2, 5)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(8)] + [(8, "짧다"), (9, None)]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(20))
        if rng.random() < 0.6:
            part = items[rng.randrange(8)][1]
            text = text[:30] + "  " + part[: int(len(part) * rng.random() * 1.3)].upper() + ", " + text[30:]
        docs.append((i, text))
    docs += [(100, None), (101, ""), (0, docs[0][1])]

    def grams(t):
        s = leakage.normalize(t)
        return {s[j : j + 12] for j in range(len(s) - 11)}

    want = {(d, i) for d, t in docs if t for i, x in items if x and grams(x) and len(grams(x) & grams(t)) >= 0.5 * len(grams(x))}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = leakage.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    by = dict(docs)
    for r in rows:
        assert leakage.normalize(by[r.doc_id][r.start_at : r.end_at])[:12] in leakage.normalize(dict(items)[r.item_id])


# -- mixture

def test_mixture_reaches_its_shares(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["말"] * rng.randrange(1, 40)), rng.choice(["big", "big", "big", "mid", "small", None])) for i in range(600)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    m = mixture.mix(d, targets).cache()
    rep = {r.source: r for r in mixture.report(m, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(rep[s].actual_share - share) < 0.02, rep[s]
    assert rep["none"].n_rows == 0 and rep["small"].epochs <= 3
    per = m.groupBy("doc_id", "epoch").count()
    assert per.where("count > 1").count() == 0
    assert mixture.mix(d, targets).exceptAll(m).count() == 0  # the same again
    assert all(r.share_met and r.repeats_met for r in mixture.checks(m, targets, d).collect())
    double = {r.source: r for r in mixture.checks(m.union(m.where("source = 'small'")), targets, d).collect()}
    assert not double["small"].repeats_met and not double["small"].share_met and double["mid"].repeats_met


def test_plan():
    assert mixture.plan({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 3)]) == {"a": (0, 30), "b": (3, 0)}
    assert mixture.plan({}, [("a", 1.0, 1)]) == {"a": (0, 0)}
    assert mixture.plan({"a": 100}, [("a", 0.5, 1), ("b", 0.5, 3)]) == {"a": (1, 0), "b": (0, 0)}


def test_many_items_take_one_scan(spark, monkeypatch):
    rng = random.Random(12)
    letters = "가나다라마바사아자차카타파하abcdefghij0123456789"
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(20, 200)))) for i in range(300)]
    docs = []
    for i in range(120):
        held = [t for _, t in rng.sample(items, rng.randrange(0, 4))]
        docs.append((i, " ".join("".join(rng.choice(letters) for _ in range(60)) + (t if rng.random() < 0.5 else t[: rng.randrange(12, len(t) + 13)]) for t in [*held, ""])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(tuple, leakage.leaks(d, i).collect()))
    whole = rows()
    grams = lambda t: {t[k : k + 12] for k in range(len(t) - 11)}
    norm = {k: leakage.normalize(t) for k, t in docs}
    want = {(k, n) for k, t in norm.items() for n, x in items if len(grams(x) & grams(t)) >= 0.5 * len(grams(x))}
    assert {r[:2] for r in whole} == want and len(want) > 50
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 700)
    monkeypatch.setattr(leakage, "SLICE_CHARS", 900)
    assert rows() == whole


def test_names_of_no_listed_kind(spark):
    groups = [
        ["국토교통부", "국토교퉁부", "국토 교통부"], ["조달청", "조달쳥"], ["Samsung Electronics", "Samsumg Electronics", "Electronics, Samsung", "Samsung Electronics Co., Ltd.", "Samsung Electr."],
        ["William Harrington", "Bill Harrington", "Harrington, William", "W. Harrington", "William Harringtn"], ["National Data Standards Agency", "NDSA"],
        ["한국정보기록원", "한국정보기륵원"], ["강원특별자치도", "강원특별자지도"],
    ]
    rows = [(x, 30 if i == 0 else 1) for g in groups for i, x in enumerate(g)]
    others = [("전주상공회의소", 20), ("진주상공회의소", 18), ("John Smith", 3), ("Jane Smith", 3), ("J. Smith", 1), ("Q", 1)]
    got = {r.name: r.agency for r in names.link(spark.createDataFrame(rows + others, "name string, n long")).collect()}
    for g in groups:
        assert {got[x] for x in g} == {g[0]}, {x: got[x] for x in g}
    for x, _ in others:
        assert got[x] == x, (x, got[x])


def test_ring_join_is_complete_and_replicates_little(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ㄱㄴㄷㄹㅁㅂㅅㅏㅓㅗㅜㅣ") for _ in range(rng.randrange(6, 22))) for _ in range(900)]
    typed = []
    for x in base[:500]:
        y = list(x)
        for _ in range(rng.randrange(3)):
            y[rng.randrange(len(y))] = rng.choice("ㅏㅓㅗ")
        typed.append("".join(y))
    left, right = (spark.createDataFrame(list(enumerate(v)), "key long, s string") for v in (typed, base))
    got = {tuple(r) for r in names.radius_join(left, right, 2).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(i, j, d) for i, a in enumerate(typed) for j, b in enumerate(base) if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}
    assert got == want and len(want) >= 500
    near, cells = names.ring_sides(left, right, 2)
    compared = near.join(cells, ["cell", "ring"]).count()
    assert cells.count() == len(base) and compared <= 0.5 * len(typed) * len(base)


def test_two_places_one_letter_apart(spark):
    kinds = ["시청", "대학교", "의료원", "문화재단", "연구원"]
    both = [(p + k, 9 if p == "전주" else 8) for p in ("전주", "진주") for k in kinds]
    got = {r.name: r.agency for r in names.link(spark.createDataFrame(both + [("잔주시청", 1)], "name string, n long")).collect()}
    assert {got[p + k] for p in ("전주", "진주") for k in kinds} == {f"{p}|{k}" for p in ("전주", "진주") for k in kinds}
