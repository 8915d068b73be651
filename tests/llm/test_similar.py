"""Groups of similar texts and the pipeline's near-duplicates, against all pairs."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np

from gridloom.llm import similar

SF = "/root/testdata/sf0.001"


def slow_groups(texts, words=5, least=0.8):
    """The number of each text's group, by comparing all pairs."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c < "\x80" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 5 * least * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def check(spark, texts, words=5, least=0.8):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    got = similar.groups(df, "k", words=words, similarity=least).collect()
    assert len(got) == len(texts)
    by, want = defaultdict(set), defaultdict(set)
    for r in got:
        by[r.g].add(r.row)
    for i, g in enumerate(slow_groups(texts, words, least)):
        want[g].add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    return want


def test_groups_of_random_texts(spark):
    """Chains of edits around the bound, a crowd of near copies, a common line, blanks, copies and short texts."""
    r = random.Random(3)
    text = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    line, out = text(30), []
    for n in (9, 40, 80):
        now = text(n)
        for _ in range(25):
            now = list(now)
            now[r.randrange(n)] = f"x{r.randint(0, 9)}"
            out.append(now)
    base = text(100)
    out += [[*base[:i], "edit", str(i), *base[i:]] for i in range(60)]
    out += [[*line, *text(k)] for k in range(1, 30)]
    texts = [" ".join(x) for x in out] + [None, "", " \t\n", "One two", "one  TWO", "one two three", "a b c d e", "a b c d e f"] + [" ".join(base)] * 4
    r.shuffle(texts)
    want = check(spark, texts)
    assert 20 < len(want) < len(texts) - 60
    check(spark, texts, 3, 0.5)


def test_parities_bound_the_difference():
    r = np.random.default_rng(0)
    for n, m, k in ((3, 1, 0), (60, 70, 50), (500, 700, 480), (5000, 4100, 4000)):
        own = r.integers(0, 1 << 63, n + m - k, dtype=np.uint64)
        a, b = np.unique(own[:n]), np.unique(own[n - k :])
        least = similar.least_difference(similar.parity(a), similar.parity(b))
        assert least == similar.least_difference(similar.parity(b), similar.parity(a)) <= n + m - 2 * k
        assert 3 * least >= n + m - 2 * k


def test_a_crowd_around_one_set(spark):
    """One set that is paired with more sets than a copy of it is sent for; links that only SimHash or only shingles show."""
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join([*base[:i], f"x{i}{k}", *base[i:]]) for i in range(0, 120, 3) for k in range(15)]
    want = check(spark, texts)
    assert len(texts) > 2 * similar._PAIRS_A_COPY and len(want) == 1


def test_similarity_at_the_bound(spark):
    """Sets of 4 and 5 shingles that share 4, which is 0.8, and one less."""
    assert len(check(spark, ["a b c d e f g h", "a b c d e f g h i"])) == 1
    assert len(check(spark, ["a b c d e f g", "a b c d e f g h"])) == 2


def test_stage_finds_all_pairs(spark):
    """Of the small table, 145 is similar to 6 and 177 to 1 at 7 and 11 differing bits."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[g][0] for g in slow_groups([t for _, t in rows])}
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert not {145, 177} & want


def test_stage_decides_by_row(spark):
    """Null ids, repeated ids, and one id with two texts, one of them a copy."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, a), (None, a), (2, b), (5, a), (5, c), (None, d), (None, d), (None, d + " end"), (None, None), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 5 and {(1, a), (2, b), (5, c), (9, " ")} <= set(got)
    assert [i for i, t in got if t and t.startswith("d0")] == [None]
