"""The near-dedup of the pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(rnd, n):
    return [f"w{rnd.randint(0, 3000)}" for _ in range(n)]


def left(texts):
    """Indices that stay: the smallest of each group joined by pairs of 0.8 or more."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in range(len(texts))}


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"] for r in corpus_pipeline.one_of_near(spark, df, "").collect()}


def test_pairs_just_alike_go(spark):
    """Copies edited so that similarities lie on both sides of 0.8."""
    rnd, texts = random.Random(2), []
    for _ in range(120):
        base = prose(rnd, rnd.choice([8, 9, 12, 30, 60, 150, 400]))
        texts.append(" ".join(base))
        for _ in range(2):
            w = list(base)
            for _ in range(rnd.randint(1, max(1, len(w) // 35))):
                w[rnd.randrange(len(w))] = f"x{rnd.random()}"
            texts.append(" ".join([*w, *prose(rnd, rnd.randint(0, len(w) // 12))]))
    want = left(texts)
    assert 150 < len(want) < 300 and kept(spark, texts) == want


def test_a_common_repeated_line_joins_nothing(spark):
    """One line of twelve words twenty times over, and eighty words of each text's own."""
    rnd = random.Random(4)
    line = " ".join(prose(rnd, 12))
    texts = ["\n".join([*[line] * 20, " ".join(prose(rnd, 80))]) for _ in range(40)]
    assert kept(spark, texts) == left(texts) == set(range(40))


def test_a_text_and_the_same_text_three_times_over(spark):
    """Nearly the same distinct shingles, a third of their number with repeats."""
    rnd, texts = random.Random(6), []
    for _ in range(30):
        w = prose(rnd, 150)
        texts += [" ".join(w), " ".join(w * 3)]
    assert kept(spark, texts) == left(texts) == set(range(0, 60, 2))


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    """Repeated and null ids: a row goes by its own text."""
    rnd = random.Random(8)
    a, b, c, d, e = (prose(rnd, 100) for _ in range(5))
    join = lambda w, *more: " ".join([*w, *more])
    rows = [
        (1, join(a)), (1, join(a, "x")), (2, join(a, "y")), (2, join(b)), (None, join(c)), (None, join(c, "x")), (None, join(d)), (5, join(d, "x")), (7, join(e)), (7, join(e)), (8, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], (r["text"] or "none").split()[0]) for r in corpus_pipeline.one_of_near(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a[0]), (2, b[0]), (None, c[0]), (5, d[0]), (7, e[0]), (8, "none")], key=str)
