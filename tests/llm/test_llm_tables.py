"""Operators that compare rows: near and substring dedup, chats, mixing, search, and the pipeline."""

import hashlib
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sheetloom.llm import chat_format, near_dup, source_mix, substring_dedup, vector_search, words
from sheetloom.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, n int")


def _near_copies(seed, n_groups=12, size=14, n_words=40):
    """Groups of mutated copies with similarities all around the threshold, short texts, repeats and nulls."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " ", "One two", "one  TWO", "solo", "solo"]
    for _ in range(n_groups):
        base = [word() for _ in range(n_words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(n_words)] = word()
            texts.append(" ".join(own))
    rng.shuffle(texts)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[8], "x", 1)]


def _sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def _components(sets):
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("leaf", [near_dup.LEAF, 4])
def test_near_duplicate_components_are_those_of_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_dup, "LEAF", leaf)  # 4: large nodes branch, and meet part by part
    rows = _near_copies(leaf)
    sets, found = _sets(rows), near_dup.near_duplicates(_docs(spark, rows)).collect()
    want = _components(sets)
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_few_and_no_rows(spark):
    assert near_dup.near_duplicates(_docs(spark, [])).collect() == []
    docs = _docs(spark, [(3, "a b c d e f", "x", 1), (3, "a b c d e f", "x", 1), (9, "a b c d e f", "y", 2), (None, "a b c d e f", "z", 3)])
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([(3, "a b c d e f", "x", 1), (None, "a b c d e f", "z", 3)], key=str)


def test_different_texts_of_one_doc_id_stay_unless_a_kept_row_holds_them(spark):
    x, y, z, u = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z", "one two three four five six")
    rows = [(1, x), (5, x), (5, y), (7, y), (8, z), (8, u), (8, u), (9, None), (9, u), (10, x), (None, x)]
    docs = _docs(spark, [(i, t, "x", 1) for i, t in rows])
    found = near_dup.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [
        (1, 4, 1, True), (5, 4, 1, False), (5, 4, 5, True), (7, 4, 5, False), (8, 4, 8, True), (8, 2, 8, True), (8, 2, 8, True),
        (9, 0, 9, True), (9, 2, 8, False), (10, 4, 1, False), (None, 4, None, True),
    ]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(1, x), (5, y), (8, z), (8, u), (9, None), (None, x)], key=str)


def test_equal_sets_are_one_class_whatever_the_chunk(spark):
    import pyarrow as pa

    texts = pa.array(["a b c d e f g", "x y", "A  b c d e f\ng", None] * 50)
    seen = {}
    for chunk in (1, 100, 1 << 20):
        for part in words.text_words(texts, lower=True, chunk=chunk):
            values, first = near_dup._shingles(part)
            for i in range(part.n_docs):
                key = texts[part.row + i].as_py() and texts[part.row + i].as_py().lower().split()
                own = values[first[i] : first[i + 1]].tolist()
                assert seen.setdefault(str(key), own) == own


def _removed(rows):
    at = {}
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                at[key] = min(at.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        gone = {j for k in range(len(w) - 12) if i is not None and at[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [False, True])
def test_repeated_passages_go_as_by_brute_force(spark, monkeypatch, heavy):
    if heavy:  # every minimiser counts as frequent: windows travel one by one
        monkeypatch.setattr(substring_dedup, "_minimisers", lambda w, n, _: np.full(n, substring_dedup.LATE))
    rng = random.Random(8)
    passages = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.choice([12, 13, 14, 60]))) for _ in range(6)]
    texts = [None, "", " ", "é z " * 20]
    for _ in range(60):
        texts.append("\n".join(rng.choice([*passages, "own" + str(rng.random()), "the the"]) for _ in range(rng.randrange(1, 5))))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts)]
    rows += [rows[9], (rows[10][0], texts[11], "same id", 2), (None, texts[12], "x", 1)]
    found = substring_dedup.remove_repeats(_docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == _removed(rows)
    assert substring_dedup.remove_repeats(_docs(spark, [])).collect() == []


def _chats(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    seqs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    out = {}
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values())
        first = min((k for k, o in seqs.items() if o == s), key=lambda k: (k is None, k or 0))
        if not longer and first == c:
            out[c] = ("".join(f"<|{r}|>\n{x.replace('<|', '< |')}<|end|>\n" for r, x in s), sum(o == s for o in seqs.values()))
    return out


@pytest.mark.parametrize("chunk", [chat_format.CHUNK, 2])
def test_snapshots_collapse_into_maximal_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat_format, "CHUNK", chunk)  # 2: totals are carried from chunk to chunk
    rng = random.Random(1)
    rows = []
    for c in range(40):
        base = random.Random(c // 5)
        whole = [(base.choice(["user", "assistant"]), base.choice(["hi", "", "<|user|>", None, "bye"])) for _ in range(9)]
        for t, (role, text) in enumerate(whole[: rng.randrange(1, 10)]):
            rows.append((c, t * 3, role, text))
    rows += [(None, 0, "user", "alone"), (77, None, None, None), (78, 5, "user", "x"), (78, None, "user", "y")]
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n int")
    found = {r["conv_id"]: (r["chat"], r["n_equal"]) for r in chat_format.format_chats(turns).collect()}
    assert found == _chats(rows)
    assert chat_format.format_chats(turns.limit(0)).collect() == []


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 4)
    turns = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(10)], "conv_id long, turn long, role string, text string")
    parts = sorted(chat_format.format_chats(turns).collect(), key=lambda r: r["part"])
    assert [r["n_turns"] for r in parts] == [4, 4, 2]
    assert "".join(r["chat"] for r in parts) == "".join(f"<|user|>\nm{t}<|end|>\n" for t in range(10))


def _dealt(budget, nodes):
    """Shares of (capacity, weight) siblings, one full sibling after the other."""
    share, left, live = {}, budget, dict(nodes)
    while live:
        total = sum(w for _, w in live.values())
        full = [k for k, (cap, w) in live.items() if cap * total <= left * w]
        if not full:
            return share | {k: left * w // total for k, (_, w) in live.items()}
        k = min(full, key=lambda k: (live[k][0] / live[k][1], k))
        share[k] = live[k][0]
        left -= live.pop(k)[0]
    return share


def test_shortages_go_to_siblings_before_ancestors(spark):
    tokens = {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 30, ("b", "y"): 5}
    leaves = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "d string, s string, tokens long")
    weights = {("a",): 1, ("b",): 1}
    for percent in (5, 20, 40, 100):
        got = {(r["d"], r["s"]): int(r["share"]) for r in source_mix.leaf_budgets(leaves, ["d", "s"], weights, percent, 2).collect()}
        tops = _dealt(545 * percent // 100, {d: (2 * sum(v for k, v in tokens.items() if k[0] == d), 1) for d in "ab"})
        want = {}
        for d in "ab":
            below = _dealt(tops[d], {s: (2 * v, 1) for (e, s), v in tokens.items() if e == d})
            want |= {(d, s): n for s, n in below.items()}
        assert got == want, percent


def test_mix_is_the_same_with_and_without_broadcast(spark, monkeypatch):
    """Half of all rows in one leaf, ids null and repeated, keys null."""
    rows = [(i % 400 if i % 9 else None, "w " * (i % 7), "en" if i % 2 else f"l{i % 11}", None if i % 5 else "s") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    keys = {"lang": F.col("lang"), "source": F.col("source")}
    results = []
    for limit in (source_mix.BROADCAST_BYTES, 0):
        monkeypatch.setattr(source_mix, "BROADCAST_BYTES", limit)
        report = source_mix.mix_report(docs, keys, {("en",): 3}, percent=70, max_epochs=2, seed=3)
        mixed = source_mix.mix_documents(docs, keys, {("en",): 3}, percent=70, max_epochs=2, seed=3)
        assert mixed.columns == docs.columns
        results.append((sorted(map(repr, report.collect())), sorted(map(repr, mixed.collect()))))
    assert results[0] == results[1] and len(results[0][0]) == len(rows)
    assert len(results[0][1]) == report.agg(F.sum("n_copies")).first()[0]


def test_mix_takes_prefixes_of_seeded_epochs(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, i) for i in range(300)] + [(None, None, "en", 0), (4, "w w w w", "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")
    keys = {"lang": F.col("lang")}
    for percent, epochs in ((50, 1), (150, 2), (1000, 3)):
        report = source_mix.mix_report(docs, keys, {("en",): 3}, percent=percent, max_epochs=epochs, seed=5).toPandas()
        assert len(report) == len(rows)
        total = report.n_tokens.sum()
        taken = (report.n_tokens * report.n_copies).sum()
        assert taken <= min(total * percent // 100, total * epochs) and taken > 0.9 * min(total * percent / 100, total * epochs)
        for _, leaf in report.groupby("lang"):
            assert leaf.n_copies.max() - leaf.n_copies.min() <= 1  # whole epochs and a part of one
    mixed = source_mix.mix_documents(docs, keys, {}, percent=50, seed=5)
    assert mixed.columns == docs.columns and 0 < mixed.count() < len(rows)
    assert source_mix.mix_report(docs.limit(0), keys, {}).collect() == []
    assert source_mix.mix_documents(docs.limit(0), keys, {}).collect() == []


def _best(rows, k=5):
    fine = [
        (i, [math.floor(256 * Fraction(x)) for x in v]) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in fine if i % 5 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12, 1e150, 1e307])
def test_top_k_is_that_of_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_search, "LEAF", 4)
    rng = random.Random(6)
    rows = [(i, [scale * rng.gauss(0, 1) if scale == 1 else scale * rng.randrange(-3, 4) for _ in range(3)], 0) for i in range(160)]
    rows += [(200 + i, rows[0][1], 0) for i in range(20)]  # ties
    rows += [(300, None, 0), (301, [1.0, None, 2.0], 0), (302, [1.0, float("nan"), 2.0], 0), (303, [1.0, float("inf"), 2.0], 0),
             (305, [1.0], 0), (310, [2.0], 0), (None, [1.0, 1.0, 1.0], 0), rows[7], rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = vector_search.top_k(table, F.col("id") % 5 == 0).select("query_id", "rank", "vec_id", "score")
    want = [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, i, s in _best(rows)]
    assert sorted(map(tuple, found.collect())) == want
    assert vector_search.top_k(table.limit(0), F.col("id") % 5 == 0).collect() == []


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(size=(500, 8)) * 256)
    tree = vector_search.BallTree(vectors, leaf=16)
    for (a, b), center, radius in zip(tree.spans, tree.centers, tree.radii):
        assert np.sqrt(((vectors[tree.order[a:b]] - center) ** 2).sum(axis=1)).max() <= radius + 1e-9


def test_pipeline_stages_on_odd_rows(spark):
    clean = "the cat and a dog of this town is here with the people that are on the way to an old house by the sea "
    rows = [
        (1, clean + "mail me at a@b.co", "en", "src0", 1), (2, clean + "mail me at a@b.co", "en", "src0", 1), (3, None, "en", "src1", 1),
        (4, "", None, None, None), (5, clean * 3000 + "long", "en", "src12", 1), (6, " ".join(f"the of{i} and{i}" for i in range(40)), None, None, None),
        (None, " ".join(f"the in{i} or{i}" for i in range(40)), "de", "src3", 5), (7, "a b", "en", "src1", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = docs
    for name, stage in corpus_pipeline.STAGES:
        before, after = after, stage(spark, after, "")
        if name != "sentencepiece":
            assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), after.schema)
        if name == "near_dedup":
            assert sorted(str(r["doc_id"]) for r in after.collect()) == ["1", "6", "None"]
        if name == "pii":
            assert "[EMAIL]" in after.where("doc_id = 1").first()["text"] and after.count() == before.count()
    assert after.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and after.where("NOT round_trip").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    own = __spark_entry__.queries()[name](spark, folder)
    theirs = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(own.columns) == sorted(theirs.columns)
    names = sorted(own.columns)
    assert sorted(map(tuple, own.select(names).collect()), key=str) == sorted(theirs.select(*names).fetchall(), key=str)
