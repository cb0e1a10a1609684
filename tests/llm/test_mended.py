"""Cases that earlier versions got wrong."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import language_id, license_scan, near_dup, pii, quality_rules
from sheetloom.llm.queries import OP7_SQL


def _kinds(text):
    return [k for k, *_ in pii.find_spans(text)]


@pytest.mark.parametrize(
    "text",
    [
        "author: https://example.com/posts/2020/intro-page", "Keyboard shortcuts: https://example.com/help/shortcuts2",
        "see api: /usr/share/doc/python3.13/html", "monkey=abcdefgh12345678xyz", "Authority: ISO-8859-1/latin-supplement",
        "key: a-quite-long-name-of-a-thing-2020", "token = AAAAAAAAAAAAAAAA1111", "secret: Donaudampfschifffahrt", "key: 12345678901234567890",
        "part 123456789", "part 123 45 6789", "security deposit 123456789", "in20 years some words follow here and there",
    ],
)
def test_clean_text_holds_no_secret(text):
    assert _kinds(text) == [] and pii.redact(text) == text


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("SSN 123456789", "ssn"), ("SSN: 123 45 6789", "ssn"), ("Social Security 123-45-6789", "ssn"),
        ("konto de89 3704 0044 0532 0130 00", "iban"), ("iban: de89370400440532013000.", "iban"), ("IBAN DE89 3704 0044 0532 0130 00", "iban"),
        ("secret: qzxvbnmwkrtypsdfghjl", "secret"), ("api_key=aGVsbG8gd29ybGQhIQ", "secret"), ("API-KEY: sk_live_9aF3kQ27xLmN4", "secret"),
        ("aws_secret = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "secret"), ('password: "Tr0ub4dor3xKq91z"', "secret"),
    ],
)
def test_personal_data_is_found(text, kind):
    assert _kinds(text) == [kind]


def test_organisations_and_things_are_no_licenses(spark):
    texts = [
        "The book was published by MIT Press.", "It was released by Apache in 2010.", "Covered by commercial insurance.", "Available by Python users.",
        "A postgresql server under new terms.", "The apache tribe holds a license to hunt.", "the boost of terms in the elastic market",
        "She studied at MIT under the terms of a grant.", "published under the title Python", "an eclipse distribution of terms", "license the public domain",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.license_report(docs).collect() if r["labels"]} == {}


def test_licenses_are_cited_in_many_ways(spark):
    texts = {
        "Licensed under the Expat License": "mit", "This is MIT licensed code": "mit", "Published under the terms of the MIT licence": "mit",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "under the terms of the GNU General Public License version 3": "gpl",
        "either the GPL or your own license": "gpl", "License: LGPL 2.1": "lgpl", "dual licensed under the AGPLv3": "agpl",
        "BSD 3-Clause License": "bsd", "a BSD style license": "bsd", "Mozilla Public License 2.0": "mpl", "licensed under CC BY-SA 4.0": "cc-by-sa",
        "https://creativecommons.org/licenses/by/4.0/": "cc-by", "GPLv2 with the classpath exception as license": "gpl",
        "Python Software Foundation License": "python", "proprietary software license": "proprietary",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.license_report(docs).collect()} == dict(enumerate(texts.values()))


def test_languages_are_learned_from_whole_texts(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
    text = lambda letters: " ".join(word(letters) for _ in range(12))
    rows = [(i, f"{text('абвгдежзик')} {'1234567890 ' * 120} {text('абвгдежзик')}", "ru") for i in range(50)]
    rows += [(100 + i, text("abcdefghij"), "en") for i in range(50)]
    rows += [(200 + i, (text("αβγδεζηθικ") + " ") * 400, "el") for i in range(12)]  # long texts only
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.language_samples(docs)
    assert set(samples) == {"ru", "en", "el"}
    whole = {" ".join(language_id.normalised(t)) for _, t, _ in rows}
    taken = {name: [w for w in whole if f" {w} " in sample] for name, sample in samples.items()}
    assert all(sum(len(w) + 1 for w in own) + 1 == len(samples[name]) for name, own in taken.items())  # whole texts and nothing else
    found = language_id.identify_languages(docs).join(docs, "doc_id")
    assert found.where("lang_pred <> lang").count() == 0


def test_predictions_and_scores_are_those_of_brute_force(spark):
    rng = random.Random(8)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30)))
    rows = [(i, text(["abcde", "cdefg", "efghi"][i % 3]), ["x", "y", "z"][i % 3]) for i in range(90)]
    rows += [(500, None, "x"), (501, "", "y"), (502, "123 !", "z"), (503, "abc" * 30_000, None), (504, "Ä ß 中文", None), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 0.5, "c") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    samples = language_id.language_samples(docs)

    def phrases(sample, cut):
        n = at = 0
        while at < len(cut):
            size = 1
            while at + size < len(cut) and cut[at : at + size + 1] in sample:
                size += 1
            at, n = at + size, n + 1
        return n

    import math

    for r in language_id.identify_languages(docs).collect():
        t = next(x[1] for x in rows if x[0] == r["doc_id"])
        words = language_id.normalised(t or "")
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        if len(words[0]) > 10_000:
            continue  # too long for brute force
        length = sum(len(w) + 1 for w in words)
        bits = {k: sum(phrases(s, f" {w} ") for w in words) * math.log2(max(2, len(s))) / length for k, s in samples.items()}
        best = min(sorted(bits), key=bits.get)
        rest = min(v for k, v in bits.items() if k != best)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(min(1, max(0, 1 - bits[best] / rest)))


def test_quality_sql_knows_labels_and_punctuation(spark):
    rng = random.Random(2)
    mixed = lambda t: " ".join(w for _ in range(3) for w in rng.sample(t.split(), len(t.split())))
    polish = "wszyscy ludzie rodzą wolni równi pod względem swej godności swych praw obdarzeni rozumem sumieniem powinni postępować wobec innych duchu braterstwa"
    english = "(the, " + "quick brown foxes jump over lazy dogs near river banks under pale moons while owls watch from old oaks"
    russian = "все люди рождаются свободными равными своём достоинстве правах они наделены разумом совестью должны поступать друг другу духе братства"
    polish, english, russian = mixed(polish), "(the, " + mixed(english[6:]), mixed(russian)
    texts = [polish, english, russian, english.replace("(the, ", ""), polish + "«of» (and) the-", "", None, mixed("Une phrase « de » mots, le chat noir dort sous une vieille table ronde depuis hier matin."), "x\n" * 60]
    labels = [None, "en", "pl", "de-AT", "und", "EN", "xx", " fr", ""]
    rows = [(len(labels) * i + j, t, lang) for i, t in enumerate(texts) for j, lang in enumerate(labels)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    con = duckdb.connect()
    frame = documents.toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    want = {r[0]: r[-1] for r in con.execute(OP7_SQL).fetchall()}
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(documents).collect()} == want
    assert len(set(want.values())) == 2


def test_repeated_rows_are_compared_once(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    other = [*words]
    other[30] = "changed"
    far = [f"v{rng.randrange(900)}" for _ in range(60)]
    rows = [(1, " ".join(words), i) for i in range(400)] + [(2, " ".join(other), i) for i in range(400)] + [(3, " ".join(far), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    named = docs.select("doc_id", "text")
    repeated = named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    near_dup.ready_workers(spark)
    assert near_dup._full_sets(named, repeated, pairs.select(F.explode(F.array("a", "b")).alias("id")), 3).count() == 2
    assert near_dup._confirmed(named, repeated, pairs, near_dup.PERCENT, 3).count() == 1
    found = near_dup.near_duplicates(docs).collect()
    assert len(found) == 801 and {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 3)}
    kept = [sorted(tuple(r) for r in near_dup.drop_near_duplicates(docs.repartition(n)).collect()) for n in (1, 7)]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 3]  # the same row of equal ones, however the rows are dealt
