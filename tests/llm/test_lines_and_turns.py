"""Line dedup, conversation tries and conversation repair, against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sheetloom.llm import line_dedup, prefix_trie, turn_repair

DOCS = "doc_id long, text string, digest int, kept string"
_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(line):
    key = line.strip(" \t\n\x0b\x0c\r").translate(_ASCII)
    return key if len(key) >= 10 else None


def _lines_left(rows):
    owners = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and _key(line):
                owners.setdefault(_key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or _key(x) is None or i == min(owners[_key(x)])]
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), text, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def _line_rows(seed):
    rng = random.Random(seed)
    lines = ["short", "a" * 9, "a" * 10, "  Hello World line\t", "hello world LINE", "é" * 9, "é" * 10, "ÉCOLE normale", "école normale", "", " \x0b "]
    lines += [f"line number {i} of the text" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))) for i in range(200)]
    long = "\n".join(f"a long text's line {i % 7000}" for i in range(20_000))
    rows += [(None, "hello world line\n" + "a" * 10), (None, None), (900, None), (901, ""), (3, "hello world line\nx"), (3, "a" * 10)]
    return [*rows, rows[0], rows[0], (902, long), (903, long + "\nend of the copy"), (904, "one line without a break " * 50_000)]


@pytest.mark.parametrize("broadcast_bytes", [line_dedup.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("flush", [line_dedup.FLUSH, 20])
def test_lines_are_dropped_as_by_brute_force(spark, monkeypatch, broadcast_bytes, flush):
    monkeypatch.setattr(line_dedup, "FLUSH", flush)  # local workers are forked and see neither change of SEGMENT_LINES
    monkeypatch.setattr(line_dedup, "SEGMENT_LINES", 1 << 16 if flush > 20 else 64)  # many segments
    rows = _line_rows(flush)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(5)
    found = line_dedup.drop_repeated_lines(docs, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept, r.kept_sha256) for r in found), key=str) == _lines_left(rows)


def test_no_documents_have_no_lines(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_only_suspects_leave_the_filter(spark):
    """Lines that only one document holds seldom pass the twice-seen filter; repeated ones always do."""
    rows = [(i, "\n".join(f"document {i} has the line {j}" for j in range(40)) + "\na line that all of them hold") for i in range(500)]
    found = line_dedup.suspected_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 500 <= found.count() < 500 + 20_000 * 0.05
    assert found.groupBy("digest").count().where("count = 500").count() == 1


TURNS = "conv_id long, turn long, role string, text string, depth string, n_convs int"


def _md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _chats(rows, default):
    """Each conversation's (turn, role, text) in order."""
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, default if role is None else role, default if text is None else text))
    for turns in out.values():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, _md5(x[1], x[2])))
    return out


def _trie(chats):
    """The nodes of sequences by conversation, by brute force over all pairs."""
    prefixes = {}
    for c, s in chats.items():
        for d in range(len(s) + 1):
            prefixes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, members in prefixes.items():
        below = [q for q in prefixes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(chats[c]) == len(p))))
        saved = sum((len(prefixes[q]) - 1) * len(q[-1][1]) for q in below if q)
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        up = min(prefixes[p[:-1]]) if p else None
        n_children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(members), len(p), up, len(members), n_children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _turn_rows(seed, n_convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(rng.choice([1, 2, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant", "system", None])
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 1]), role, rng.choice(["", None, "a", "bb", "é😀", "long " * 50])))
    rows += [(c, t, "user", f"turn {t}") for c in range(200, 260) for t in range(4)]  # one large group of copies
    rows += [(300 + c, t, "user", f"turn {t}") for c in range(20) for t in range(c + 1)]  # each a prefix of the next
    rows += [(-7, 0, "user", "a"), (-7, 0, "user", "a"), (705, 0, "user", "left empty by its absent giver"), (None, 0, "user", "a"), (None, None, None, None)]
    rows += [(800, t, "user" if t % 2 else "assistant", "w" * (t % 3)) for t in range(700)]
    return rows


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _nodes(found):
    return sorted((tuple(r[c] for c in NODE) for r in found.collect()), key=str)


@pytest.mark.parametrize("shard_turns", [prefix_trie.SHARD_TURNS, 20])
def test_tries_are_those_of_brute_force(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 1 if shard_turns == 20 else 16)  # ids of one node in many pieces
    rows = [r for r in _turn_rows(shard_turns) if shard_turns == 20 or r[0] != 800]
    chats = {c: [x[1:] for x in s] for c, s in _chats(rows, "").items() if c is not None}
    numbered = prefix_trie.numbered_turns(_turns(spark, rows)).cache()
    if shard_turns > 20:
        assert _nodes(prefix_trie.trie_nodes(prefix_trie.plain(numbered), shard_turns)) == _trie(chats)
    built = {}
    for c, s in chats.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = chats.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + s[h:]
    assert [] in built.values()  # a conversation that is left without turns
    if shard_turns == 20:
        built = {c: s for c, s in built.items() if c != 800}
        numbered = numbered.where("conv_id <> 800")
    assert _nodes(prefix_trie.trie_nodes(prefix_trie.branched(numbered), shard_turns)) == _trie(built)


def test_a_long_conversation_is_one_path(spark):
    rows = [(1, t, "user", "word") for t in range(5000)] + [(2, t, "user", "word") for t in range(4000)]
    found = {r["depth"]: r for r in prefix_trie.trie_nodes(prefix_trie.plain(prefix_trie.numbered_turns(_turns(spark, rows)))).collect()}
    assert len(found) == 5001 and found[0]["saved_tokens"] == 4 * 4000 and found[4001]["n_convs"] == 1
    assert found[0]["n_leaves"] == 1 and found[4000]["n_convs"] == 2 and found[4000]["n_children"] == 1


def test_no_conversations_have_no_trie(spark):
    assert prefix_trie.trie_nodes(prefix_trie.branched(prefix_trie.numbered_turns(_turns(spark, [(None, 1, "user", "x")])))).collect() == []


def test_ternary_trees_are_searched_in_balance():
    tree = prefix_trie.TernaryTree()
    for k in prefix_trie._medians(1000):
        tree.insert([k], [1], k)
    steps = []
    for code in range(1000):
        node, n = tree.equal[0], 1
        while tree.code[node] != code:
            node, n = (tree.lower[node] if code < tree.code[node] else tree.higher[node]), n + 1
        steps.append(n)
    assert max(steps) == 10


def _damaged(rows):
    out = []
    for c, t, role, text in rows:
        if c is None:
            continue
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _walked(letters):
    """The least (cost, audit) through the states of the grammar; X must go, capitals are truncated."""
    best = {"S": (0, "")}

    def inserted(b):
        for _ in range(3):
            for s, (c, a) in list(b.items()):
                t = "U" if s == "A" else "A"
                b[t] = min(b.get(t, (9**9, "")), (c + 2, a + "I"))
        return b

    best = inserted(best)
    for x in letters:
        new = {}
        for s, (c, a) in best.items():
            ways = [(s, (c + 3, a + "D"))]
            if x != "X":
                cost = c + x.isupper()
                same = x.lower() == ("a" if s == "A" else "u")
                ways.append(("U" if s == "A" else "A", (cost + (0 if same else 2), a + ("K" if same else "R"))))
                if s == "S" and x.lower() == "s":
                    ways.append(("P", (cost, a + "K")))
            for t, found in ways:
                new[t] = min(new.get(t, (9**9, "")), found)
        best = inserted(new)
    return min(best[s] for s in "SU" if s in best)


def _repair(turns):
    turns_of = [t for t, _, _ in turns if t is not None]
    gaps = max(turns_of) - min(turns_of) + 1 - len(set(turns_of)) if turns_of else 0
    seen, letters, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        x = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "X" if fault in ("blank", "duplicate") else x.upper() if fault else x
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    cost, audit = _walked(letters)
    m, k, i, lines = len(audit) - audit.count("D"), 0, 0, []
    for edit in audit:
        k += edit != "D"
        role = "user" if (k + m) % 2 else "assistant"
        if edit != "D":
            lines.append(f"{turns[i][1] if edit == 'K' else role}:{'' if edit == 'I' else turns[i][2]}")
        i += edit != "I"
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _spoken(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, f"Line {rng.randrange(10**6)}.", "end. \x0b\n", "é中."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
    rows = [(c, t if rng.random() < 0.95 else None, role(), text()) for c in range(150) for t in range(rng.choice([1, 2, 4, 5, 9]))]
    for c, n in ((1000, 300), (1001, 64), (1002, 65), (1003, 1500)):  # long ones, turns missing and repeated
        rows += [(c, t // 2 if t % 50 == 0 else t, role(), text() if rng.random() < 0.3 else f"Turn {t} of {c}.") for t in range(n)]
    rows += [(1004, None, "user", "The same.")] * 400 + [(1005, 7, role(), text()) for _ in range(200)]
    rows += [(1006, t, ["user", "assistant"][t % 2], "w " * 20_000 + f"{t}.") for t in range(6)]
    return [*rows, (None, 0, "user", "No one's."), (2000, 5, None, None), (2001, None, None, None), (-3, 2, "user", "Hm."), (-3, 2, "user", "Hm.")]


@pytest.mark.parametrize("block", [turn_repair.BLOCK, 3])
def test_repairs_are_those_of_a_walk_through_the_grammar(spark, block):
    rows = _spoken(block)
    chats = _chats(_damaged(rows), " ")
    found = turn_repair.repair_report(_turns(spark, rows), block).collect()
    assert {r["conv_id"] for r in found} == {r[0] for r in rows if r[0] is not None} and len(found) == len({r["conv_id"] for r in found})
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for r in found:
        turns = chats.get(r["conv_id"], [])
        assert tuple(r[c] for c in names) == (_repair(turns) if turns else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), r["conv_id"]


def test_sound_conversations_are_left_alone(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Turn {t} of {c}.") for c in range(20) for t in range(2 * c)]
    rows += [(50, 0, "system", "Be kind."), (50, 1, "user", "Hello!"), (50, 2, "assistant", "Good day.")]
    for r in turn_repair.repair_conversations(_turns(spark, rows)).collect():
        assert r["cost"] == 0 and set(r["audit"]) <= {"K"}
        assert r["repaired"] == "\n".join(f"{x[2]}:{x[3]}" for x in rows if x[0] == r["conv_id"])


def test_cheapest_edits_by_all_short_signatures():
    for n in range(5):
        for letters in itertools.product("XsuaoSUA", repeat=n):
            assert turn_repair.cheapest("".join(letters)) == _walked(letters)


def test_no_turns_need_no_repair(spark):
    assert turn_repair.repair_report(_turns(spark, [])).collect() == []
