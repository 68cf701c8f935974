import random

import pytest

from quillspark.llm import scans, toxicity

NOUNS = "회계 자산 교육 보안 민원 통계 예약 산림".split()
THINGS = "관리 화면 이관 작업 검색 기능 점검표 운영 지침".split()


def clean_sentence(rng):
    return rng.choice([
        f"{rng.choice(NOUNS)} {rng.choice(THINGS)}의 목표 수준은 {rng.randrange(100)}%로 정하고 운영자가 매월 측정한다.",
        f"{rng.choice(NOUNS)} {rng.choice(THINGS)} 산출물은 {rng.randrange(30)}부 인쇄하고 전자 파일은 담당자가 보관한다.",
        f"장애인 접근성과 이주민 다국어 안내를 {rng.choice(NOUNS)} 화면에 보완한다.",
    ])


def bad_sentence(rng, kind):
    if kind == "abusive":
        return rng.choice([f"병신 같은 {rng.choice(NOUNS)} {rng.choice(THINGS)} 만든 놈 찾아가서 패 버린다.", "꺼져 버려라 멍청한 놈들.", f"한심한 새끼들, {rng.choice(NOUNS)} 하나 못 하면서 월급만 받냐."])
    if kind == "hateful":
        g = rng.choice("여자들은 노인네들은 난민들은 이민자들은".split())
        return rng.choice([f"{g} 다 쫓아내야 나라가 깨끗해진다.", f"{g} 애초에 입찰에 끼워 주면 안 되는 열등한 족속이다."])
    return rng.choice(["오늘 밤 화끈하게 같이 잘 성인 남녀 만남.", f"회의 내내 {rng.choice(NOUNS)} 직원 엉덩이만 생각나서 흥분됐다."])


def disguise(rng, s):
    out = []
    for c in s:
        out.append(c + (rng.choice(["@", ".", "ㅡ", "​", " "]) if c.isalpha() and rng.random() < 0.15 else ""))
    return "".join(out)


def make(seed, n):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        own = [clean_sentence(rng) for _ in range(rng.randrange(4, 9))]
        label = rng.choices(toxicity.CLASSES, [0.8, 0.08, 0.07, 0.05])[0]
        if label != "clean":
            s = bad_sentence(rng, label)
            own.insert(rng.randrange(len(own)), disguise(rng, s) if rng.random() < 0.3 else s)
        docs.append((i, " ".join(own), label))
    return docs


def test_held_out_accuracy(spark):
    train, test = make(1, 700), make(2, 400)
    docs = spark.createDataFrame([(i, t, "s1") for i, t, _ in train] + [(10_000 + i, t, "s2") for i, t, _ in test] + [(99_998, None, None), (99_999, "", "s2")], "doc_id long, text string, source string")
    # a few labels are wrong
    labels = spark.createDataFrame([(i, "clean" if i % 50 == 7 else c) for i, _, c in train] + [(3, "unknown"), (None, "abusive")], "doc_id long, label string")
    scored = toxicity.scores(docs, labels).cache()
    got = {r.doc_id: r for r in scored.collect()}
    assert got[99_998].score == 0 and got[99_998].category is None and got[99_999].score == 0
    flagged = {i for i in got if got[i].score >= toxicity.THRESHOLD and 10_000 <= i < 90_000}
    true = {10_000 + i: c for i, _, c in test if c != "clean"}
    assert len(flagged & set(true)) >= 0.95 * len(true)
    assert len(flagged - set(true)) <= 0.02 * len(test)
    assert sum(got[i].category == true[i] for i in flagged & set(true)) >= 0.95 * len(flagged & set(true))
    rates = {r.source: r for r in toxicity.rates(scored).collect()}
    assert rates["s2"].n_docs == 401 and rates["s2"].n_flagged == len(flagged)


def test_groups_do_not_change_the_score(spark):
    docs = make(3, 500)
    common = toxicity.common_slots(spark.createDataFrame([(t,) for _, t, _ in docs], "text string"))
    w, b = toxicity.train([(t, c) for _, t, c in docs], common)

    def p(s):
        of, r, f = toxicity.features([s])
        return 1 - toxicity.softmax(toxicity.logits(len(of), r, f, w, b))[:, 0].max()

    for group in ("외국인", "여성", "노인", "난민"):
        assert p(f"{group} 접근성과 이주민 다국어 안내를 화면에 보완한다.") < 0.3
        assert p(f"{group}들은 다 쫓아내야 나라가 깨끗해진다.") > 0.5


def test_more_bad_labels_than_the_sample_holds(spark):
    docs = [(i, t, c) for i, t, c in make(11, 1500)]
    bad = [(i, c) for i, _, c in docs if c != "clean"]
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in docs], "doc_id long, text string, source string")
    labels = spark.createDataFrame(bad + [(i, "clean") for i, _, c in docs if c == "clean"][:400], "doc_id long, label string")
    assert len(bad) > 200
    flagged = {r.doc_id for r in toxicity.scores(df, labels, rows=200).where(f"score >= {toxicity.THRESHOLD}").collect()}
    true = {i for i, _ in bad}
    assert len(flagged & true) >= 0.95 * len(flagged) and len(flagged & true) >= 0.9 * len(true)


def test_common_counts_do_not_depend_on_the_layout(spark):
    docs = make(5, 300)
    df = spark.createDataFrame([(i % 3, t) for i, t, _ in docs], "s int, text string")
    one, eight, sorted_ = (toxicity.common_slots(x) for x in (df.coalesce(1), df.repartition(8), df.repartitionByRange(3, "s")))
    assert (one == eight).all() and (one == sorted_).all() and (one > 0).any()


def test_the_sample_is_bounded_in_characters(spark):
    df = spark.createDataFrame([(i, "x" * (50 if i else 5000), "clean" if i % 2 else "abusive") for i in range(40)], "doc_id long, text string, label string")
    got = toxicity.labelled_sample(df.select("doc_id", "text"), df.select("doc_id", "label"), chars=600)
    assert sum(len(t) for t, _ in got) <= 600


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "회계 자료를 보관한다.", "s")], "doc_id long, text string, source string")
    rows = toxicity.scores(docs, spark.createDataFrame([], "doc_id long, label string")).collect()
    assert len(rows) == 1 and rows[0].score < toxicity.THRESHOLD


@pytest.mark.parametrize("n_bad, n_clean, want", [(40, 40, (10, 10)), (400, 40, (10, 10)), (6, 400, (6, 14)), (40, 4, (16, 4)), (3, 5, (3, 5))])
def test_the_sample_keeps_clean_documents(spark, n_bad, n_clean, want):
    rows = [(i, f"text {i}", toxicity.CLASSES[1 + i % 3] if i < n_bad else "clean") for i in range(n_bad + n_clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = [label for _, label in toxicity.labelled_sample(df.select("doc_id", "text"), df.select("doc_id", "label"), rows=20)]
    assert (sum(x != "clean" for x in got), got.count("clean")) == want


def test_page_numbers():
    for s in ("12", "- 12 -", "— l2 —", "Page 9", "10쪽", "[26]", "9 / 14", "viii", "— ll —"):
        assert scans.is_page_number(s), s
    for s in ("844건", "계약 기간: 2026. 5. 1. -", "제6조 (추진 배경)", "한다.", "2027.", "- 도서관 인증 체계"):
        assert not scans.is_page_number(s), s


def test_numbers_and_strays():
    assert scans.fix_numbers("2O26년") == "2026년" and scans.fix_numbers("5,l70명에서") == "5,170명에서" and scans.fix_numbers("B월") == "8월"
    assert scans.fix_numbers("SIR-20l에") == "SIR-201에" and scans.fix_numbers("29MB를") == "29MB를" and scans.fix_numbers("SLA와") == "SLA와"
    assert scans.drop_strays("판단으§로") == "판단으로" and scans.drop_strays("총사업비는") == "총사업비는" and scans.drop_strays("급여·안전") == "급여·안전"


def test_pages(spark):
    rng = random.Random(6)
    swaps = {"관": "판", "한": "힌", "정": "징", "보": "브", "를": "률"}
    filler = "가나다라마바사아자차카타파하거너더러머버서어저"
    vocabulary = ["".join(rng.choice(filler) for _ in range(rng.randrange(1, 3))) + rng.choice("관한정보") + rng.choice(filler) for _ in range(70)]
    vocabulary += ["".join(rng.choice(filler) for _ in range(3)) + rng.choice(["를", "는"]) for _ in range(70)]
    rows, planted = [], {}
    rid = 0
    for doc in range(12):
        for page in range(8):
            rid += 1
            words = [w + ("." if i % 9 == 8 else "") for i, w in enumerate(rng.choice(vocabulary) for _ in range(160))]
            lines, now = [], ""
            for w in words:
                if len(now) + len(w) > 32:
                    lines.append(now)
                    now = ""
                now = (now + " " + w).strip()
            lines.append(now)
            marks = {}
            for i in range(len(lines) - 1):
                if rng.random() < 0.05 and len(lines[i].split()[-1]) > 2 and lines[i][-1].isalpha():
                    head, _, tail = lines[i].rpartition(" ")
                    lines[i], lines[i + 1] = f"{head} {tail[:2]}¬", tail[2:] + " " + lines[i + 1]
                    marks.setdefault(i, set()).add("broken_word")
            for i, line in enumerate(lines):
                at = [k for k, c in enumerate(line[:-3]) if c in swaps]
                if at and rng.random() < 0.06:
                    k = rng.choice(at)
                    lines[i] = line[:k] + swaps[line[k]] + line[k + 1 :]
                    marks.setdefault(i, set()).add("misread")
            text = "\n".join([f"입찰공고문 | 기관{'가나다라마바사아자차카타'[doc]}시청", *lines, f"- {page + 10} -"])
            planted |= {(rid, 1, "header"): 1, (rid, len(lines) + 2, "page_number"): 1} | {(rid, i + 2, m): 1 for i, ms in marks.items() for m in ms}
            rows.append((rid, f"d{doc}", "f.hwp", "page_scan", text if page else None, None if page else "이미지 OCR 텍스트:\n" + text))
            if not page:
                planted = {(r, n + (r == rid), k): 1 for r, n, k in planted}
    rows += [(5000, "d0", "f.hwp", "page_scan", None, None), (5001, "d0", "f.hwp", "page_scan", "", None), (5002, None, None, "embedded_image", "표\n12", None), rows[3]]
    im = spark.createDataFrame(rows, "record_id long, doc_id string, file_name string, source_type string, ocr_text string, combined_context string")
    out = scans.repaired(im).cache()
    got = {(r.record_id, x.line_no, x.noise) for r in out.collect() for x in r.noises}
    for kind in ("header", "page_number", "broken_word", "misread"):
        a, b = {x for x in got if x[2] == kind}, {x for x in planted if x[2] == kind}
        assert len(a & b) >= 0.85 * len(b), (kind, len(a & b), len(b), sorted(b - a)[:5])
        assert len(a - b) <= 0.1 * len(b) + 2, (kind, sorted(a - b)[:5])
    text = {r.record_id: r.text for r in out.collect()}
    assert text[5001] == "" and 5000 not in text and "입찰공고문" not in text[2] and "¬" not in text[2]
    assert {r.field_name for r in scans.found(im).collect()} == {"ocr_text", "combined_context"}


def test_running_lines_of_long_and_unnamed_documents(spark):
    rng = random.Random(3)
    body = lambda: "\n".join("".join(chr(rng.randrange(0xAC00, 0xD7A0)) for _ in range(30)) for _ in range(6))
    # a chapter's header on 20 of 300 pages, and 30 documents of 4 pages each without a doc_id
    rows = [(i, "d", "a.pdf", i, ("둘째 마당의 머리글\n" if 100 <= i < 120 else "") + body()) for i in range(300)]
    rows += [(1000 + 4 * d + i, None, f"{d}.pdf", i, chr(0xAC00 + 500 * d % 11000) * 4 + " 문서 머리글\n" + body()) for d in range(30) for i in range(4)]
    im = spark.createDataFrame([(r, d, f, n, "page_scan", t, None) for r, d, f, n, t in rows], "record_id long, doc_id string, file_name string, image_number int, source_type string, ocr_text string, combined_context string")
    got = {(r.record_id, r.line_no) for r in scans.furniture(scans.pages(im)).where("noise = 'header'").collect()}
    assert got == {(i, 1) for i in range(100, 120)} | {(1000 + i, 1) for i in range(120)}


def test_context_decides_about_rare_words(spark, monkeypatch):
    rng = random.Random(8)
    swaps = {"관": "판", "한": "힌", "정": "징"}
    filler = "가나다라마바사아자차카타파하거너더러머버서어저"
    vocabulary = ["".join(rng.choice(filler) for _ in range(rng.randrange(1, 3))) + rng.choice("관한정") + rng.choice(filler) for _ in range(70)]
    vocabulary += ["".join(rng.choice(filler) for _ in range(3)) for _ in range(70)]
    rows, own, misread = [], set(), set()
    for page in range(100):
        lines = []
        for _ in range(20):
            line = " ".join(rng.choice(vocabulary) for _ in range(8))
            at = [k for k, c in enumerate(line) if c in swaps]
            if at and rng.random() < 0.06:
                k = rng.choice(at)
                line = line[:k] + swaps[line[k]] + line[k + 1 :]
            lines.append(line)
        for _ in range(3):  # a frequent word and its neighbours
            lines.insert(5, "고성 노원 가관나 도봉 동해 완도")
        if page % 12 == 0:  # misread there, and a word of its own elsewhere that looks the same
            lines[6] = lines[6].replace("관", "판")
            misread.add((page, 7))
        if page % 9 == 0:
            lines.append("여주 이천 가판나 평택 화성 오산")
            own.add((page, len(lines)))
        rows.append((page, f"d{page}", "f.hwp", page, "page_scan", "\n".join([*lines, "마지막 줄" + str(page), "끝 줄" + str(page)]), None))
    im = spark.createDataFrame(rows, "record_id long, doc_id string, file_name string, image_number int, source_type string, ocr_text string, combined_context string")
    found = lambda: {(r.record_id, r.line_no) for r in scans.found(im).where("noise = 'misread'").collect()}
    got = found()
    assert misread <= got and not own & got
    full = scans.skip_gram_space
    monkeypatch.setattr(scans, "skip_gram_space", lambda r: scans.Space(full(r).shares, full(r).vectors * 0))
    assert own & found()  # without vectors, the word's contexts say nothing


def test_glyph_edits_anywhere_in_a_word():
    edits = {"판": {"관": 0.02}, "징": {"정": 0.03}}
    classes = scans.syllable_classes(edits)
    assert scans.glyph_key("판징" * 9, classes) == scans.glyph_key("관정" * 9, classes)
    assert scans.log_misread("판징" * 9, "관정" * 9, edits) < 0 and scans.log_misread("관정", "판징", edits) is None
    for word, right in (("rnoclern", "modern"), ("cloclcs", "dodes"), ("c1ick", "click"), ("vveb", "web"), ("eliecli", "eheeh")):
        assert scans.glyph_key(word, {}) == scans.glyph_key(right, {}) and scans.log_misread(word, right, {}) < 0, word
    assert scans.log_misread("modern", "rnodern", {}) is None
