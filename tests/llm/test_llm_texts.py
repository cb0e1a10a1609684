"""Row-wise operators: quality rules, PII, SentencePiece, license scans, language identification."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sheetloom.llm import language_id, license_scan, pieces, pii, quality_rules
from sheetloom.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, n_words string, `odd col` int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the cat and a dog of this town is here " * 30_000
TEXTS = [
    None, "", " \t\n", "one", "the cat sat on the mat and the dog ran to the old house of a friend in this town by the sea",
    "Line a\nLine a\nLine b\n \n", "x " * 40, "### $$$ %%% &&& *** " * 10, "a b c d e f g h " * 6, "a b c d e f g h i a b c d e f g h",
    "é ü 中文 \U0001F600 mit license", "MIT-License!apache   license", LONG,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "7", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None), rows[4]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_quality_counts_are_those_of_brute_force(docs, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality_rules.quality_report(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert tuple(r[n] for n in names) == _quality(text), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_report(none).collect() == []


def test_quality_filter_keeps_columns_and_clean_rows(docs):
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 4]


def test_quality_rules_can_be_given(docs):
    rule = quality_rules.Rule("short", "n_words", low=5)
    broken = {r["doc_id"]: r["broken"] for r in quality_rules.quality_report(docs, rules=(rule,)).collect()}
    assert broken[3] == ["short"] and broken[4] == []


def _lines(words, n):
    rng = random.Random(1)
    return " ".join(rng.choice(words) for _ in range(n))


def test_stop_words_judge_only_covered_languages(spark):
    russian, greek, arabic, hindi, korean = "дом стоит у реки", "το σπίτι είναι κοντά", "البيت قريب من النهر", "घर नदी के पास है", "집은 강 옆에 있다"
    clean = [_lines(t.split(), 60) for t in (russian, greek, arabic, hindi, korean)]
    rows = [(i, t, lang) for i, t in enumerate(clean) for lang in (None, "xx", "en")]
    polish, junk = _lines("dom stoi przy rzece".split(), 60), _lines("cheap pills casino win".split(), 60)
    rows += [(10, polish, "pl"), (11, polish, None), (20, junk, "en"), (21, junk, "en-US"), (22, junk + " the", None), (23, junk, "pl")]
    rows += [(30, _lines("house, «the» (of river".split(), 60), "en"), (31, _lines(["the,", "river", "(near", "it)", "stands"], 60), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    broken = {}
    for r in quality_rules.quality_report(docs).collect():
        broken.setdefault(r["doc_id"], set()).add("stop_words" in r["broken"])
    assert {i for i, x in broken.items() if x != {False}} == {20, 21, 22}
    assert sorted({r["doc_id"] for r in quality_rules.filter_documents(docs).collect()}) == [0, 1, 2, 3, 4, 10, 11, 23, 30, 31]
    assert {r["doc_id"] for r in quality_rules.filter_documents(docs.drop("lang")).collect()} >= {0, 1, 2, 3, 4, 10, 11}


PARTS = ["a", "b.c", "@", ".", "-", "x@y.zz", "1", "256", "0", ".7", "4111111111111111", "4111 1111-1111 1111", "+", "+1 (743) 555-3824", " ", "é"]


def _base_spans(text):
    found = []
    for kind, pattern in enumerate((
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = (
                True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15,
            )[kind]
            if fits:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_are_those_of_plain_patterns():
    import random

    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        own = [(a, pii.KINDS.index(k), b) for k, a, b, _ in pii.find_spans(text) if k in pii.BASE_KINDS]
        assert own == _base_spans(text), text


def test_more_kinds_need_a_checksum_or_context():
    kinds = lambda text: [s[0] for s in pii.find_spans(text)]
    assert kinds("account GB82WEST12345698765432") == ["iban"] and kinds("account GB82WEST12345698765433") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3"') == ["secret"] and kinds("x = 24be64439e3e49cf46b2d7c90f3602a3") == []


def test_an_iban_ends_where_its_check_digits_fit():
    ibans = lambda text: [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == "iban"]
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO9386011117947"
    for after in ("", " BIC DEUTDEFF", " 2024", " A", ", BIC", " and", " " + "X" * 40, " 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"):
        for number in (gb, de, no):
            assert ibans(f"IBAN {number}{after}") == [number], (number, after)
    assert ibans(f"AB12 CODE {gb} {de} {no}") == [gb, de, no]
    assert ibans("GB82 WEST 1234 5698 7654 33 BIC DEUTDEFF") == [] and ibans(f"{de}X") == [] and ibans(f"X{de}") == []
    assert pii.redact(f"IBAN {gb} BIC DEUTDEFF") == "IBAN [IBAN] BIC DEUTDEFF"
    pii.find_spans("AB12 " * 200_000)


def test_secrets_are_whole_and_context_may_follow():
    for n in (16, 512, 513, 900, 100_000):
        value = ("aB3dE5gH" * (n // 8 + 1))[:n]
        assert pii.redact(f'token = "{value}"; end') == 'token = "[SECRET]"; end'
    kinds = lambda text: [s[0] for s in pii.find_spans(text)]
    assert kinds("123-45-6789 (SSN)") == ["ssn"] and kinds("123-45-6789" + " " * 40 + "SSN") == []
    assert kinds("x = 24be64439e3e49cf46b2d7c90f3602a3 (the API key)") == ["secret"]
    assert kinds("so 123-45-6789 cial") == []  # the sides are not read as one
    for text in ("=" * 1_000_000, "=a" * 500_000, ": a1b2c3d4" * 100_000):
        pii.find_spans(text)


def test_pii_over_a_table(spark, docs, none):
    rows = spark.createDataFrame([(1, "é a@b.co"), (2, None), (2, None)], "doc_id long, text string")
    found = sorted(pii.pii_report(rows).collect(), key=lambda r: r["doc_id"])
    assert (found[0]["n_email"], found[0]["spans"]) == (1, "email:2:8")
    assert found[0]["base_sha256"] == hashlib.sha256(b"email:2:8").hexdigest()
    assert found[1] == found[2] and found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.redact_documents(rows).where("doc_id = 1").first()["text"] == "é [EMAIL]"
    assert pii.redact_documents(docs).columns == docs.columns
    assert pii.pii_report(none).collect() == []


def test_long_texts_without_matches_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "@a" * 500_000, "+1" + " " * 1_000_000):
        pii.find_spans(text)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(piece_model())


def test_encoding_and_decoding_are_the_library_s(model):
    import random

    rng = random.Random(2)
    parts = ["the", "in", " ", "  ", "\n", "é", "▁", "\U0001F600", "ing", "1", "<s>", "\t", "日本", "\x00"]
    texts = ["", " ", "▁", "a" * 300, "日本語" * 40, *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(800))]
    ids, at = model.encode_batch(texts)
    whole = model.library.encode(texts, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == whole
    assert model.decode_batch(ids, at) == [model.library.decode(x) for x in whole]
    for _ in range(500):
        some = [rng.choice([rng.randrange(300), rng.randrange(32000), 259, 2]) for _ in range(rng.randrange(12))]
        assert model.decode(some) == model.library.decode(some)


def test_heap_and_side_by_side_agendas_agree(model):
    texts = ["▁information", "▁aaaaaaaa", "\nword", "▁Üñï"]
    ids, sizes = model.ids_of(texts)
    assert ids.tolist() == [i for t in texts for i in model._ids(t)] and sizes.sum() == len(ids)


def test_tokens_over_a_table(docs, none, model):
    rows = pieces.token_report(docs, piece_model()).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = model.library.encode(text, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()
    assert pieces.token_report(none, piece_model()).collect() == []


def _phrases(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, sorted(found)


def test_license_base_is_that_of_brute_force(spark, none):
    far = "word " * 254 + "MIT license " + "word " * 300 + "GNU general public\nlicense mit license mit license"
    texts = [*TEXTS[:-1], far, "mit licenses", "the apache license apache license", "General. Public; LICENSE", "mİt license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.license_report(docs).collect():
        words, found = _phrases(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (len(words), len(found)), r
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert license_scan.license_report(none).collect() == []


def test_contained_detections_are_suppressed(spark):
    texts = [
        "Released under the MIT License.", "SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "nothing to see",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    spans = {i: [(d["start"], d["end"], d["label"]) for d in r["detections"]] for i, r in rows.items()}
    assert spans[0] == [(0, 5, "mit")]  # not "mit license" on its own as well
    assert ("apache" in {x[2] for x in spans[1]}) and (0, 6, "apache") in spans[1]
    assert {x[2] for x in spans[2]} == {"cc-by-nc"} and spans[3] == [(0, 13, "mit")] and spans[4] == []
    assert len(license_scan.signatures()) > 200


def _shortest(parsed):
    """What matches of a parsed pattern look like that take every branch, and as little as they can of what repeats."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "IN":
            own = [chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg]
        elif name == "NOT_LITERAL":
            own = ["~"]
        elif name == "BRANCH":
            own = [x for part in arg[1] for x in _shortest(part)]
        elif name == "MAX_REPEAT":
            own = ["".join(c) for c in itertools.product(_shortest(arg[2]), repeat=arg[0])]
        else:
            assert name == "SUBPATTERN", name
            own = _shortest(arg[-1])
        out = [a + b for a in out for b in own]
    return out


def test_every_license_rule_implies_its_keyword_and_the_gate():
    for rule in license_scan.signatures():
        found = _shortest(re._parser.parse(rule.pattern))
        assert found
        for text in found:
            assert re.fullmatch(rule.pattern, text), (rule, text)
            assert any(k in text for k in rule.keyword.split("|")), (rule, text)
            assert any(k in text for k in license_scan.GATE), (rule, text)


def test_license_names_need_no_other_word_beside_them(spark):
    texts = {
        "Licensed under the Expat License": "mit", "X11 license": "mit", "ASL 2.0 license": "apache",
        "You may not use this file except in compliance with the License.": "apache",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in license_scan.license_report(docs).collect()}
    assert found == dict(enumerate(texts.values()))


def test_suffix_automaton_parses_into_longest_matches():
    import random

    rng = random.Random(4)

    def brute(sample, text):
        count = at = 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in sample:
                n += 1
            at += n
            count += 1
        return count

    for _ in range(300):
        sample = "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(15)))
        assert language_id.SuffixAutomaton(sample).phrases(text) == brute(sample, text), (sample, text)


def test_languages_of_held_out_rows(spark, none):
    stems = {"en": ["the", "house", "thing", "with", "which"], "de": ["der", "haus", "schön", "und", "nicht"]}
    rows = [(i, " ".join(stems[lang][(i + k) % 5] for k in range(12)), lang) for i in range(80) for lang in ("en", "de")]
    rows += [(900, None, "en"), (901, "12 ... ½", "en"), (None, "und der schön", None), (902, "WHICH thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify_languages(docs).join(docs, "doc_id")
    assert found.where("doc_id < 900 AND held_out").count() > 10
    assert found.where("doc_id < 900 AND lang_pred NOT IN ('en', 'de')").count() == 0
    out = {r["doc_id"]: r for r in language_id.identify_languages(docs).collect()}
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[902]["lang_pred"] == "en"
    assert out[None]["held_out"] is False and out[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.identify_languages(none).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify_languages(unlabelled).collect()} == {"und"}


def test_every_label_is_learned(spark):
    script = lambda k: "".join(chr(0x4E00 + 7 * k + j) for j in range(7))
    rows = [(100 * k + i, script(k), f"l{k:02}") for k in range(70) for i in range(8 if k else 4)]
    rows += [(9000 + i, "12 ...", "l99") for i in range(50)] + [(9100 + i, "ж" * 9, "l99") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.language_samples(docs)) == {f"l{k:02}" for k in range(70)} | {"l99"}
    wrong = language_id.identify_languages(docs).join(docs, "doc_id").where("text <> '12 ...' AND lang_pred <> lang")
    assert wrong.count() == 0
