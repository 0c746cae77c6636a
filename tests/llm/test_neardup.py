import random

from ledgerlens.llm.components import components
from ledgerlens.llm.neardup import near_duplicates


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    """{id: component} by comparing every pair."""
    s = {i: sets(t) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for x in range(len(ids)):
        for y in range(x):
            a, b = s[ids[x]], s[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def corpus(seed, families=12, size=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, line = [], " ".join(rng.choice(vocabulary) for _ in range(15))
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        for _ in range(size if f else 120):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 20, len(w) // 10])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[rng.choice(vocabulary)], [], [w[k], rng.choice(vocabulary)]]) or ["x"]
            text = " ".join(w)
            rows.append((line + "\n" + text) if rng.random() < 0.3 else text.upper() if rng.random() < 0.1 else text)
    rows += [None, "", " \t\n", "one", "ONE", "one two", "é È", "È é"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1000))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets(dict(rows)[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_against_every_pair(spark):
    check(spark, corpus(1))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (3, "zz"), (3, "a b c d e f g"), (4, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [
        ("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("3", 1, "1", False), ("3", 3, "1", False), ("4", 0, "4", True), ("None", 3, "None", True),
    ]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    chain = list(range(60))
    rng.shuffle(chain)
    links = [(a, b) for a, b in zip(chain, chain[1:])] + [(100, 101), (101, 100), (102, 102)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100}
