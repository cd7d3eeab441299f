"""MinHash near-dedup against brute force, with a large group of near copies; the sketches' estimates."""

import random

import numpy as np

from loomspan.llm import odd_sketch


def brute(rows):
    sets = []
    for _, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    while True:
        new = [min([root[i], *[root[j] for j in linked[i]]]) for i in range(n)]
        if new == root:
            break
        root = new
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted((str(d), len(s), str(d if not s else least.get(root[i]))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus():
    random.seed(11)
    words = [f"w{i}" for i in range(3000)] + ["É", "The"]
    base = [random.choice(words) for _ in range(120)]
    texts = []
    for _ in range(120):  # near copies, many of them too far from each other
        some = list(base)
        for _ in range(random.randint(0, 8)):
            some[random.randrange(len(some))] = random.choice(words)
        texts.append(" ".join(some))
    texts += [" ".join(random.choice(words) for _ in range(random.randint(1, 60))) for _ in range(60)]
    texts += [t.upper() for t in texts[100:140]] + ["one two", "ONE  two", "one two three four five", " ".join(["x"] * 9000)]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \t"), (7, texts[7]), (None, texts[150]), (None, None), (None, "alone at last")]
    random.shuffle(rows)
    return rows


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(odd_sketch, "BLOCK", 16)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_shingles int")
    got = odd_sketch.near_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    kept = odd_sketch.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {d for d, _, root in brute(rows) if d == root}
    assert sorted({str(i) for i in ids}) == sorted(want) and len([i for i in ids if i is not None]) == len(want - {"None"})


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert odd_sketch.near_documents(empty).count() == 0 and odd_sketch.one_of_each(empty).count() == 0


def test_estimates_are_close_and_never_lose_a_link():
    rng = np.random.default_rng(7)
    for size in (40, 300, 3000, 20_000):
        off = []
        for _ in range(25):
            j = rng.uniform(0.74, 0.95)
            shared = int(2 * size * j / (1 + j))
            pool = rng.integers(1, 1 << 63, 2 * size - shared, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:shared], pool[size:]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sketches = [odd_sketch.describe(x)[2:] for x in (a, b)]
            x, y = (np.array([odd_sketch.popcount(np.frombuffer(p, np.uint64) ^ np.frombuffer(q, np.uint64))]) for p, q in zip(*sketches))
            if odd_sketch.links(a, b):
                assert odd_sketch.may_link(x, y, np.array([len(a)]), np.array([len(b)]))[0]
            d, _ = odd_sketch.differences(x, odd_sketch.SKETCH_BITS)
            off.append(1 - d[0] / (2 * odd_sketch.SAMPLES) - true)
        assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.08
