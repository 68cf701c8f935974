import random

import pytest

from quillspark.llm import near_dup
from quillspark.llm.components import connected_components
from quillspark.llm.fold import fold

WORDS = "통합 시험 운영 지침 검색 기능 자료 보안 점검 계약 담당 자산 교육 훈련 이관 작업 품질 지표 알림 체계".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(rng.randrange(3, 60)))
        rows.append((f"c{i:03d}", t))
        if rng.random() < 0.5:
            w = t.split()
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((f"e{i:03d}", "  ".join(w) if rng.random() < 0.5 else " ".join(w)))
    return rows + [("x1", "짧음"), ("x2", "짧음"), ("x3", "짧은"), ("y1", None), ("y2", " "), ("c000", rows[0][1])]


def brute(rows):
    t = {i: fold(x) for i, x in rows if x and x.strip()}
    k = sorted(t)
    return {(a, b) for i, a in enumerate(k) for b in k[i + 1 :] if near_dup.jaccard(t[a], t[b]) >= 0.6}


@pytest.mark.parametrize("heavy", [None, 1, 120, 1 << 62])
def test_pairs_match_brute_force(spark, monkeypatch, heavy):
    if heavy is not None:
        monkeypatch.setattr(near_dup, "boundary", lambda _: heavy)
    rows = corpus()
    got = [tuple(r) for r in near_dup.found(spark.createDataFrame(rows, "chunk_id string, text string")).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    missed = want - set(got)
    assert not missed if heavy == 1 else len(missed) <= 0.01 * len(want)


@pytest.mark.parametrize("run", [1, 3, 10, 1000])
def test_long_runs_are_compared_in_blocks(spark, run):
    rng = random.Random(run)
    rows = [(rng.choice([1, 1, 1, 2, 3, 10 + i % 7]), i, rng.randrange(4)) for i in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "k long, tid long, c int").repartition(3)
    got = {tuple(r) for r in near_dup.pairs_within(df, lambda x, y: x[2] != y[2], run).collect()}
    once = sorted(set(rows))
    assert got == {(min(i, j), max(i, j)) for k, i, c in once for m, j, d in once if k == m and i < j and c != d}


def test_small_sets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "boundary", lambda _: 1 << 62)
    rng = random.Random(9)
    letters = [chr(c) for c in range(0xAC00, 0xAC00 + 2000)]
    rows = []
    for i in range(150):
        same = rng.randrange(10, 72)  # fewer than SMALL elements in all
        x = "".join(rng.choices(letters, k=same + 4))
        for j in range(3):  # similarities of 0.6 and a little above
            rows.append((f"{i:03d}{j}", x + "".join(rng.choices(letters, k=same // 3 - j // 2))))
    rows += [("r1", "가나다라마바사" * 200), ("r2", "가나다라마바사" * 90)]  # long texts of few elements
    got = {tuple(r) for r in near_dup.found(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    want = brute(rows)
    assert len(want) > 400 and got == want


def test_boundary_minimises_cost():
    assert near_dup.boundary([]) == 1 << 62
    few_large = near_dup.boundary([(100, 1_000_000, 120.0), (5000, 3, 5200.0)])
    assert few_large == 5000  # a few large sets are cheaper to scan for
    assert near_dup.boundary([(400, 1_000_000, 400.0)]) == 1 << 62


def test_groups(spark):
    base = " ".join(f"{w}{i}" for i, w in enumerate(WORDS * 3))
    rows = [("a", base), ("b", base), ("c", base.replace("통합0", "다른말")), ("d", "전혀 다른 내용의 글입니다 정말로"), ("a", base)]
    g = {r.id: r for r in near_dup.NearDuplicates(spark.createDataFrame(rows, "chunk_id string, text string")).groups().collect()}
    assert len(g) == 4 and g["a"].group_key == g["b"].group_key == g["c"].group_key != g["d"].group_key
    assert g["a"].text_key == g["b"].text_key != g["c"].text_key
    assert (g["a"].n_links, g["c"].n_links, g["d"].n_links) == (1, 1, 0)


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}
    for n in parent:
        least[find(n)] = min(least.get(find(n), n), n)
    assert got == {n: least[find(n)] for n in parent}
