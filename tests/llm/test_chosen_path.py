import random
import re

from loamdex.llm import chosen_path
from tests.llm.data import table


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets)


def check(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")
    assert sorted(map(tuple, chosen_path.group(frame, **how).collect())) == brute(rows)


def edited(words, rng, share):
    return [w if rng.random() > share else f"e{rng.randint(0, 999)}" for w in words]


def test_groups(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    rows = []
    for _ in range(12):  # near copies of several strengths, some below the limit
        base = text(200)
        rows += [" ".join(edited(base, rng, s)) for s in (0, 0.005, 0.01, 0.02, 0.03, 0.05)]
    base = text(300)
    rows += [" ".join(edited(base, rng, 0.01)) for _ in range(80)]  # a dense group
    chain = text(100)
    for _ in range(8):  # a chain: only neighbours are similar
        rows.append(" ".join(chain))
        chain = chain[4:] + text(4)
    rows += ["A b c", "a B C", "a b", None, "", " \n", "One two three FOUR five", "one two three four five", rows[0], rows[0].upper(), rows[5]]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows, 10)))


def test_edited_copies_that_only_meet_in_their_original(spark):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(500)]
    rows = [" ".join(edited(base, rng, 0.02)) for _ in range(200)]
    check(spark, list(enumerate([*rows[:100], " ".join(base), *rows[100:]], 10)))


def template(own, twins, seed):
    """Texts of one template with `own` of 400 words of their own in a row, half of them with a twin."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 99999)}"
    shared, rows = [word() for _ in range(400)], []
    for _ in range(twins):
        mine = [word() for _ in range(own)]
        rows.append(" ".join(shared[:200] + mine + shared[200:]))
        at = rng.randrange(own - 12)
        rows.append(" ".join(shared[:200] + mine[:at] + [word() for _ in range(12)] + mine[at + 12 :] + shared[200:]))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def test_twins_among_strangers_just_below_the_limit(spark):
    rows = template(64, 150, 5)
    sets = [shingles(t) for _, t in rows]
    common = [100 * len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 70 < min(common) < 75 and sum(c >= 75 for c in common) == 1
    check(spark, rows)
    check(spark, rows, leaf=40)  # all nodes are split, and coherent


def test_branches_beyond_the_first_levels(spark, monkeypatch):
    """Large nodes that aren't coherent: many documents share a passage and little else."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for _ in range(100):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        rows += [" ".join(shared + base), " ".join(shared + base[:-2])] if rng.random() < 0.3 else [" ".join(shared + base)]
    check(spark, list(enumerate(rows)), leaf=8)


def test_forest():
    import numpy as np

    rng = np.random.default_rng(1)
    for m in (2, 30, 90):
        tokens = rng.integers(0, 2 + m % 3, (m, 64)).astype(np.uint8)
        edges, tree, likely = chosen_path.forest(tokens)
        equal = (tokens[:, None] == tokens[None]).sum(2)
        near = (equal >= chosen_path.LIKELY) & ~np.eye(m, dtype=bool)
        assert (near.sum(1) == likely).all()
        assert all(near[i, j] and equal[i, j] == n for i, j, n in edges) and len(edges) == m - len(set(tree))
        assert (tree[:, None] == tree[None])[near].all()


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(map(str, range(50)))
    rows = [(None, t), (1, t), (1, t), (2, None), (None, "x")]
    found = chosen_path.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(None, 46, 1, False), (1, 46, 1, True), (1, 46, 1, True), (2, 0, 2, True), (None, 1, None, True)], key=str)
    assert chosen_path.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_test_table(spark):
    check(spark, [(r.doc_id, r.text) for r in table(spark, "documents").collect()])
