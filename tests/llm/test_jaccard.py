import random
import re

from sluice.llm.jaccard import jaccard_components


def sets(text, k):
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num, den):
    s = [sets(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and min(len(s[i]), len(s[j])) * den >= max(len(s[i]), len(s[j])) * num:
                o = len(s[i] & s[j])
                if o * den >= (len(s[i]) + len(s[j]) - o) * num:
                    up[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(s[i]), best.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n, long=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.7:
            t = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                p = r.randrange(len(t) + 1)
                kind = r.random()
                if kind < 0.4 and p < len(t):
                    t[p] = r.choice(words)
                elif kind < 0.7:
                    t.insert(p, r.choice(words))
                elif p < len(t) and len(t) > 1:
                    del t[p]
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 20, 30, long, 5 * long]))))
    return texts


def check(spark, rows, k, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_components(df, k, num, den).collect()), key=repr)
    assert got == brute(rows, k, num, den)


def test_against_brute_force(spark):
    for seed, (k, num, den) in enumerate([(3, 9, 10), (5, 8, 10), (1, 8, 10)]):
        rows = list(enumerate(corpus(seed, 350)))
        random.Random(seed).shuffle(rows)
        check(spark, [(i * 7 + 3, t) for i, t in rows], k, num, den)


def test_near_copies_in_one_group_and_long_texts(spark):
    r = random.Random(5)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        t[r.randrange(120)] = f"y{i}"
        rows.append((i, " ".join(t)))
    long = [f"z{i}" for i in range(12000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[:11000])), (902, " ".join(long[:10000]))]
    check(spark, rows, 3, 9, 10)


def test_copies_near_the_threshold_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("sluice.llm.jaccard.BLOCK", 40)
    r = random.Random(9)
    base = [f"x{i}" for i in range(90)]
    rows = []
    for i in range(110):
        t = list(base)
        for _ in range(r.choice([1, 2, 2, 3, 3, 4])):
            t[r.randrange(90)] = f"y{r.randrange(400)}"
        rows.append((i, " ".join(t)))
    check(spark, rows, 3, 9, 10)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "A b"), (5, "a B"), (6, "a b c"), (7, "É b"), (8, "é b"), (4, "A b"), (9, "a b"), (10, "a,b")]
    check(spark, rows, 3, 9, 10)
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string, node long, label string"), 3, 9, 10).collect() == []


def test_same_words_in_other_forms(spark):
    rows = [(5, "The cat sat on the mat"), (2, "the  CAT\nsat on the\tmat"), (9, "other words here")]
    check(spark, rows, 3, 9, 10)


def test_null_and_repeated_ids_link_as_their_texts_do(spark):
    texts = corpus(11, 160)
    rows = [(None if i % 3 == 0 else i % 40, t) for i, t in enumerate(texts)] + [(None, texts[0])] * 4 + [(7, texts[1])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_components(df, 3, 9, 10).collect()), key=repr)
    assert got == brute(rows, 3, 9, 10)


def test_components_that_travel_packed(spark, monkeypatch):
    monkeypatch.setattr("sluice.llm.jaccard.PACK", 1)
    monkeypatch.setattr("sluice.llm.jaccard.FLUSH_KEYS", 3000)
    rows = [(i, t) for i, t in enumerate(corpus(21, 300, 90))]
    check(spark, rows, 3, 8, 10)


def test_overlaps_of_fragments_add_up(spark):
    import numpy as np

    from sluice.llm import jaccard

    r = random.Random(2)
    texts = corpus(4, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.mapInArrow(jaccard._sets(3), "doc_id long, node long, n long, bits binary, grams array<binary>").collect()
    assert all(len(x.grams) == jaccard.FRAGMENTS and sum(map(len, x.grams)) == 8 * x.n for x in rows)
    by = {x.doc_id: x for x in rows}
    split = 0
    for _ in range(200):
        x, y = r.sample(sorted(by), 2)
        part = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))) for a, b in zip(by[x].grams, by[y].grams)]
        split += sum(p > 0 for p in part) > 1
        assert sum(part) == len(sets(texts[x], 3) & sets(texts[y], 3))
    assert split


def test_intermediate_tables_are_deleted(spark):
    import os

    from sluice.llm import storage

    rows = list(enumerate(corpus(31, 80)))
    at = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    check(spark, rows, 3, 9, 10)
    left = {x.split("-")[0] for x in set(os.listdir(at)) - before}
    assert left <= {"profile", "nodes", "labels", "components"}


def test_bitmaps_never_differ_more_than_sets():
    import numpy as np

    from sluice.llm import jaccard

    r = np.random.default_rng(3)
    pruned = 0
    for _ in range(500):
        n, m, shared = int(r.integers(1, 900)), int(r.integers(0, 500)), 0
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(r.integers(0, len(x) + 1))], r.integers(0, 2**63, m + 1, dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        least = jaccard.differing(jaccard.parity(x), jaccard.parity(y))
        assert least <= len(x) + len(y) - 2 * shared and jaccard.differing(jaccard.parity(x), jaccard.parity(x)) == 0
        pruned += least * 18 > (len(x) + len(y)) * 2
    assert pruned > 200


def test_lists_that_share_a_text_are_groups_of_their_own(spark, monkeypatch):
    from sluice.llm import jaccard

    r = random.Random(17)
    words = lambda n: " ".join(f"x{r.randrange(10**6)}" for _ in range(n))
    passages = [words(24) for _ in range(4)]
    texts = [f"{words(12)} {p} {words(12)}" for p in passages for _ in range(120)]
    texts += [f"{words(6)} {p} {words(6)} {q} {words(6)}" for p, q in zip(passages, passages[1:]) for _ in range(12)]
    texts += [t.replace(t.split()[3], "other") for t in texts[::40]]
    rows, groups, dealt = list(enumerate(texts)), [], jaccard._dealt

    def seen(group, payload, most):
        groups.append(sorted((x["count"] for x in group.groupBy("grp").count().collect()), reverse=True))
        return dealt(group, payload, most)

    monkeypatch.setattr(jaccard, "_dealt", seen)
    check(spark, rows, 5, 8, 10)
    assert groups and groups[0][0] <= 150  # holders of one passage; all of them hang together


def test_groups_of_components_that_travel_packed():
    import numpy as np
    import pyarrow as pa

    from sluice.llm import jaccard

    # lists of keys 1 and 2: component 5 stands for itself in both, 30 nodes alone in each; node 9 is in both lists of keys 3 and 4
    key = [1] * 31 + [2] * 31 + [3] * 20 + [4] * 20
    node = [6, *range(100, 130), 7, *range(200, 230), 9, *range(300, 319), 9, *range(2, 5), *range(400, 416)]
    label = [5, *range(100, 130), 5, *range(200, 230), 9, *range(300, 319), 9, *range(2, 5), *range(400, 416)]
    packed = [1, *[0] * 30] * 2 + [0] * 40
    cols = {"bucket": pa.array([0], pa.int32()), "keys": [np.array(key, np.uint32).tobytes()], "place": [np.arange(len(key), dtype=np.uint16).tobytes()]}
    cols |= {"nodes": [np.array(node, np.int64).tobytes()], "labels": [np.array(label, np.int64).tobytes()], "packed": [np.array(packed, np.uint8).tobytes()]}
    out = jaccard._crosses((pa.scalar(0),), pa.table(cols)).to_pylist()
    got = {}
    for x in out:
        got.setdefault((x["n"], x["a"]), set()).add(x["b"])
    whole, alone = jaccard.WHOLE, jaccard.IN_BLOCKS
    assert got == {
        (whole, 5): {5},
        (alone, 5): {6, 7, *range(100, 130), *range(200, 230)},
        (alone, 9): {9, *range(300, 319)},
        (alone, 2): {9, *range(2, 5), *range(400, 416)},
    }
