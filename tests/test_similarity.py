import random

import numpy as np
import pytest

from sheetloom.operators import similarity as sim
from sheetloom.operators.components import connected_components
from sheetloom.operators.distinct import drop_rows
from tests.conftest import values


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def keys_of(texts):
    return [" ".join(sorted(t.lower().split())) for t in texts]


def brute_pairs(texts, threshold):
    first = {}
    for i, k in enumerate(keys_of(texts)):
        first.setdefault(k, i)
    reps = list(first.items())
    return {
        (min(i, j), max(i, j))
        for n, (a, i) in enumerate(reps)
        for b, j in reps[n + 1 :]
        if 200 * min(len(a), len(b)) >= threshold * (len(a) + len(b))
        and 200 * sim.lcs_length(a, b) >= threshold * (len(a) + len(b))
    }


def brute_groups(texts, threshold):
    keys, parent = keys_of(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    equal = {(first.setdefault(k, i), i) for i, k in enumerate(keys)}
    for a, b in equal | brute_pairs(texts, threshold):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    return {g: m for g, m in groups.items() if len(m) > 1}


def groups_of(df):
    found = {}
    for r in df.collect():
        assert r["group_id"] == r["keep_row_id"]
        found.setdefault(r["group_id"], []).append((r["row_id"], r["group_size"]))
    assert all(size == len(m) for m in found.values() for _, size in m)
    return {g: sorted(i for i, _ in m) for g, m in found.items()}


def test_lcs():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 90))) for _ in "ab")
        assert sim.lcs_length(a, b) == lcs_table(a, b)


def test_rarest_chunks():
    rnd = np.random.default_rng(2)
    for n, chunks in [(20, 3), (31, 5), (60, 8), (1500, 180), (5000, 600)]:
        cost = {w: rnd.random(n) for w in (6, 4, 3)}
        found = sim.rarest_chunks(cost, n, chunks)
        assert len(found) >= chunks
        assert all(a + w <= b for (a, w), (b, _) in zip(found, found[1:])) and found[-1][0] + found[-1][1] <= n


def mutated(rnd, text, letters):
    s = list(text)
    for _ in range(rnd.randint(0, max(1, len(s) // 6))):
        i, kind = rnd.randrange(len(s) + 1), rnd.random()
        if kind < 0.4 and s:
            s.pop(min(i, len(s) - 1))
        else:
            s.insert(i, rnd.choice(letters))
    return "".join(s)


@pytest.mark.parametrize(
    "threshold, letters, low, high", [(87, "abcd ", 0, 30), (87, "abcdefghij  ", 10, 90), (60, "abcdef ", 1, 25), (40, "abcdefgh ", 1, 9)]
)
def test_join_equals_brute_force(sheet, threshold, letters, low, high):
    rnd = random.Random(threshold + high)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(40)]
    texts = base + [mutated(rnd, rnd.choice(base), letters) for _ in range(160)]
    df = sheet("t string", texts)
    pairs = {(r[0], r[1]) for r in sim.similar_pairs(df, threshold=threshold).collect()}
    assert pairs == brute_pairs(texts, threshold)
    assert groups_of(sim.similar_groups(df, threshold=threshold)) == brute_groups(texts, threshold)


def test_boilerplate_and_copies(sheet):
    """A third of the rows are copies, and all texts share long passages."""
    rnd = random.Random(9)
    names = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(60)]
    texts = ["zz yy status open city of mumbai"] * 60 + [f"{n} city of mumbai" for n in names]
    texts += [mutated(rnd, t, "abc") for t in texts[60:90]]
    df = sheet("t string", texts)
    assert groups_of(sim.similar_groups(df)) == brute_groups(texts, 87)


def test_long_texts(sheet):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(230)) for _ in range(6)]
    texts = base + [" ".join(w for w in b.split() if rnd.random() > 0.05) for b in base] + [b[:1200] for b in base[:2]]
    df = sheet("t string", texts)
    assert {(r[0], r[1]) for r in sim.similar_pairs(df).collect()} == brute_pairs(texts, 87)


def test_names(sheet, messy):
    df = sheet("Name string, Age long", [("Mona Lind", 1), (" mona  LIND", 2), ("Lind Mona", 3), ("Quentin", 4), (None, 5), ("", 6)])
    groups = sim.similar_groups(df)
    assert groups_of(groups) == {0: [0, 1, 2], 4: [4, 5]}
    assert values(drop_rows(df, sim.duplicates_to_drop(groups)), "Age") == [1, 4, 5]
    assert groups_of(sim.similar_groups(df, max_rows=2)) == {0: [0, 1]}
    assert sim.similar_groups(df.select("_row_id", "Age")).count() == 0
    for bad in (0, 101):
        with pytest.raises(ValueError):
            sim.similar_pairs(df, threshold=bad)
    assert groups_of(sim.similar_groups(messy, ["Tool", "Shelf"])) == {0: [0, 1, 9], 2: [2, 5]}


def test_chain_and_threshold_edge(sheet):
    chain = ["abcdefghijklmnop", "abcdefghijklmnXY", "abcdefghijklZZXY"]
    df = sheet("t string", chain)
    assert {(r[0], r[1]) for r in sim.similar_pairs(df).collect()} == {(0, 1), (1, 2)}
    assert groups_of(sim.similar_groups(df)) == {0: [0, 1, 2]}
    edge = ["a" * 87 + "b" * 13, "a" * 87 + "c" * 13]  # exactly 87
    assert sim.similar_pairs(sheet("t string", edge)).first()["score"] == 87.0
    assert sim.similar_pairs(sheet("t string", edge), threshold=88).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(2000 + rnd.randrange(80), 2000 + rnd.randrange(80)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for u, v in edges if u != v for x in (u, v)}
    df = spark.createDataFrame(edges, "u long, v long")
    rows = connected_components(df).collect()
    assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want
    early = {r["node"]: r["component"] for r in connected_components(df, max_rounds=1).collect()}
    assert set(early) == set(want) and all(want[c] == want[n] for n, c in early.items())


def test_members_are_the_rows_behind_a_pair(sheet):
    df = sheet("Name string, n long", [(x, 1) for x in ["red  apple", "Apple red", None, "apple red ", "pear", "", "red apples"]])
    found = {r["row_id"]: r["representative"] for r in sim.text_members(df).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 2, 6: 6}
    pairs = sim.similar_pairs(df, ["Name"], 90).collect()
    assert {(r["left_row_id"], r["right_row_id"]) for r in pairs} == {(0, 6)}
    assert {i for i, rep in found.items() if rep == 0} == {0, 1, 3}


def test_lcs_of_many_pairs():
    rng = random.Random(5)
    left = ["".join(rng.choices("abcé文😀 ", k=rng.randint(0, 90))) for _ in range(3000)] + ["a" * 64, "a" * 65, "", "x", "a" * 64]
    right = ["".join(rng.choices("abdé文 x", k=rng.randint(0, 90))) for _ in range(3000)] + ["a" * 64, "a" * 70, "", "", "b" * 300]
    assert sim.lcs_lengths(left, right).tolist() == [sim.lcs_length(a, b) for a, b in zip(left, right)]
    assert sim.lcs_lengths(left[:200], right[:200]).tolist() == [lcs_table(a, b) for a, b in zip(left[:200], right[:200])]
    assert sim.lcs_lengths([], []).tolist() == []


@pytest.mark.parametrize("threshold", [40, 60])
def test_rarest_letters_lose_no_pair(sheet, threshold):
    rng = random.Random(threshold)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 12))) for _ in range(150)]
    texts = words + [w[: rng.randint(2, len(w))] + rng.choice("xyz") for w in words] + ["", "a", "文", "文書"]
    df = sheet("t string", texts)
    found = {(r["left_row_id"], r["right_row_id"]) for r in sim.similar_pairs(df, threshold=threshold).collect()}
    assert found == brute_pairs(texts, threshold)
    if threshold == 60:
        _, reps = sim._representatives(df, ["t"])
        reps = reps.withColumn("component", reps["rep"])
        assert sim._candidates(reps, threshold, across_components=False).count() < 20 * len(found)


def test_filter_of_index_keys_only_saves_work(sheet, monkeypatch):
    """A filter far too small for its keys lets everything pass, and the pairs stay."""
    texts = ["alpha beta gamma", "alpha beta gama", "delta epsilon", "delta epsilom", "unlike anything else"]
    df = sheet("t string", texts)
    whole = sim.similar_pairs(df).collect()
    monkeypatch.setattr(sim, "FILTER_BITS", (64, 64))
    assert sorted(sim.similar_pairs(df).collect()) == sorted(whole) and len(whole) == 2


def test_dense_groups_leave_few_candidates(sheet, monkeypatch):
    """Linked neighbours are one component to its end, so a dense group lists no pairs of its own."""
    listed = []
    plain = sim._candidates

    def counted(*args, **more):
        found = plain(*args, **more)
        listed.append(found.count())
        return found

    monkeypatch.setattr(sim, "_candidates", counted)
    hosts = ["www.thther", "m.thther", "blog.tionble"]
    texts = [f"https://{hosts[i % 3]}.example.org/en/{i * 7919 % 10_000}{'?page=2&ref=x' if i % 5 == 0 else ''}" for i in range(240)]
    found = groups_of(sim.similar_groups(sheet("Url string", texts), ["Url"]))
    assert found == brute_groups(texts, 87)
    assert listed[0] <= len(texts)


def test_a_few_candidates_of_two_components_do_not_stand_for_the_rest(spark):
    """The first tries between two components fail, a later candidate matches."""
    far, near = [f"{c * 9}z" for c in "abcdefgh"], ["xyxyxyxyxy", "xyxyxyxyxx"]
    reps = spark.createDataFrame(
        [(i, t, 0) for i, t in enumerate(far + near[:1])] + [(20, near[1], 20), (30, "q" * 9, 30)], "rep long, s string, component long"
    )
    pairs = [(i, 20, 0, 20) for i in range(9)] + [(0, 30, 0, 30)]
    merged = sim._merged(spark.createDataFrame(pairs, "a long, b long, u long, v long"), reps, 87)
    assert {tuple(r) for r in merged.collect()} == {(0, 0), (20, 0)}


HOSTS = ["tionsh.example.net", "www.thther.example.org", "m.tionble.example.com"]
ENDS = ["", "?utm_source=feed", "?page=2&ref=x"]


def urls(n, seed=7):
    rnd = random.Random(seed)
    return [f"https://{rnd.choice(HOSTS)}/en/{rnd.randrange(10 * n)}{rnd.choice(ENDS)}" for _ in range(n)]


def test_components_that_lie_apart_need_no_keys(sheet, monkeypatch):
    """Large components with words in common would meet at every key of those words."""
    monkeypatch.setattr(sim, "_gram_sketch", None)
    listed = []
    plain = sim._boxed_candidates
    monkeypatch.setattr(sim, "_boxed_candidates", lambda *a: listed.append(plain(*a)) or listed[0])
    texts = urls(400)
    df = sheet("Url string", texts)
    assert groups_of(sim.similar_groups(df, ["Url"])) == brute_groups(texts, 87)
    assert listed[0].count() <= len(texts)


def test_letter_order_links_what_other_orders_leave_apart(sheet):
    texts = urls(300)
    _, reps = sim._representatives(sheet("Url string", texts), ["Url"])
    linked = connected_components(sim._neighbour_edges(reps, 87))
    of = {r["node"]: r["component"] for r in linked.collect()}
    found = {of.get(i, i) for i in range(len(texts))}
    assert len(found) <= 2 * len(brute_groups(texts, 87))


@pytest.mark.parametrize(
    "threshold, limits",
    [(87, {"BOX_MEETINGS": 0}), (40, {"TEXT_MEETINGS": -1}), (87, {"CANDIDATES_A_TEXT": 0}), (40, {"CANDIDATES_A_TEXT": 0}),
     (87, {"BOX_PART": 2, "BOX_DEALS": 3}), (1, {}), (100, {})],
)
def test_both_ways_across_components_are_exact(sheet, monkeypatch, threshold, limits):
    for name, value in limits.items():
        monkeypatch.setattr(sim, name, value)
    rnd = random.Random(threshold)
    base = ["".join(rnd.choice("abcdef 文é12") for _ in range(rnd.randint(0, 24))) for _ in range(25)]
    texts = base + [mutated(rnd, rnd.choice(base), "abcdef 12") for _ in range(60)] + urls(30)
    assert groups_of(sim.similar_groups(sheet("t string", texts), threshold=threshold)) == brute_groups(texts, threshold)


@pytest.mark.parametrize("alike", [0, 1])
def test_boxes_lose_no_match(spark, monkeypatch, alike):
    """Every match across components is among the candidates, and each pair is there once."""
    monkeypatch.setattr(sim, "BOX_PART", 3)
    monkeypatch.setattr(sim, "ALIKE", sim.ALIKE[alike : alike + 1])
    rnd = random.Random(11)
    base = urls(60) + ["".join(rnd.choice("abcdefgh 12") for _ in range(rnd.randint(1, 40))) for _ in range(60)] + ["a" * 700]
    texts = list(dict.fromkeys(t for t in (mutated(rnd, rnd.choice(base), "abc12/") for _ in range(160)) if t)) + urls(90, 8)
    reps = spark.createDataFrame([(i, t, i % 5) for i, t in enumerate(texts)], "rep long, s string, component long")
    for threshold in (30, 87):
        rows = sim._boxed_candidates(reps, threshold).collect()
        found = [tuple(sorted((r["a"], r["b"]))) for r in rows]
        want = {
            (i, j)
            for i, a in enumerate(texts)
            for j, b in enumerate(texts)
            if i < j
            and i % 5 != j % 5
            and 200 * min(len(a), len(b)) >= threshold * (len(a) + len(b))
            and 200 * sim.lcs_length(a, b) >= threshold * (len(a) + len(b))
        }
        assert all((r["u"], r["v"]) == (r["a"] % 5, r["b"] % 5) and r["u"] != r["v"] for r in rows)
        assert len(found) == len(set(found)) and want <= set(found) and len(want) > 50


def test_runs_go_on_over_batches():
    import pandas as pd

    texts = ["abcdefghijklmnop", "zzzzzzzzzzzzzzzz", "abcdefghijklmnoq", "abcdefghijklmnor", "zzzzzzzzzzzzzzzy", "q"]
    for size in (1, 2, 6):
        batches = [pd.DataFrame({"rep": range(10 + i, min(10 + i + size, 16)), "s": texts[i : i + size]}) for i in range(0, 6, size)]
        out = pd.concat(list(sim._run_batches(87, 4)(iter(batches))))
        rows = [tuple(r) for r in out[["rep", "leader"]].to_numpy().tolist()]
        ends = out[out["edge"].notna()]
        assert ends["rep"].tolist() == [10, 15] and ends["edge"].tolist() == [texts[0], texts[-1]]
        near = brute_groups(texts, 87)
        parent = {}
        for u, v in rows:
            a, b = u, v
            while a in parent:
                a = parent[a]
            while b in parent:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
        found = {}
        for u in range(10, 16):
            r = u
            while r in parent:
                r = parent[r]
            found.setdefault(r - 10, []).append(u - 10)
        assert {g: m for g, m in found.items() if len(m) > 1} == near
        narrow = pd.concat(list(sim._run_batches(87)(iter(batches))))
        assert narrow["rep"].tolist() == list(range(10, 16))
