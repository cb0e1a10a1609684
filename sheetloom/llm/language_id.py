"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of a sample of labelled text.
A text is parsed against each: from where it stands, the longest match in the
sample is one phrase.  The language whose sample gives the fewest phrases,
each weighed by the logarithm of the sample's length, for each character, wins.

Phrases end at word ends, so a word's phrases are counted once and kept, and a
text is a sum over its words; no text is cut short.  Every label is learned, of
whole texts.  The rows learned from are bounded: `SAMPLE_DOCS` documents of a
language (fewer, but one at least, where that makes more than `ALL_DOCS` in all),
texts of at most `LONG_TEXT` characters first, then by the order of a hash, as far
as they have `SAMPLE_CHARS` characters together; the first is always taken.
Documents whose crc32 (of the id as text) leaves 2 modulo 4 are never learned from.

A null text, or one without a letter, is ``und`` with score 0, as is every text
if nothing was learned.  Ties go to the first language by name.  Rows without
an id are not held out, and not learned from.  Repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.batches import ready_workers

SAMPLE_DOCS = 40
SAMPLE_CHARS = 40_000
LONG_TEXT = 4000
ALL_DOCS = 2560  # documents of all languages together, above which each has fewer
CACHED_CHARS = 4_000_000  # letters of words whose phrases a worker keeps; a full cache is emptied
_WORDS = re.compile(r"[^\W\d_]+").findall


def normalised(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS(text.lower())


class SuffixAutomaton:
    """All substrings of a text as paths from state 0; ``step[state][character]``."""

    def __init__(self, text: str):
        self.step: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(length)
            self.step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(length)
                    self.step.append(dict(self.step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.step[p].get(c) == q:
                        self.step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def phrases(self, text: str) -> int:
        """Longest matches that make up the text; a character that the automaton lacks is one."""
        step, root = self.step, self.step[0]
        count, here = 0, None
        for c in text:
            on = here.get(c) if here is not None else None
            if on is None:  # a phrase begins
                count += 1
                on = root.get(c)
                here = None if on is None else step[on]
            else:
                here = step[on]
        return count


class LanguageModel:
    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.automata = [SuffixAutomaton(samples[name]) for name in self.names]
        self.weights = np.array([math.log2(max(2, len(samples[name]))) for name in self.names])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.counts = np.zeros((1, len(self.names) + 1), np.int64)

    def learn(self, words: list[str]) -> None:
        rows = np.zeros((len(words), len(self.names) + 1), np.int64)
        for i, word in enumerate(words):
            self.known[word] = len(self.counts) + i
            self.held += len(word)
            if any(map(str.isalpha, word)):
                cut = f" {word} "
                rows[i] = [*(a.phrases(cut) for a in self.automata), len(cut) - 1]
        self.counts = np.concatenate([self.counts, rows])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.names:
            return [("und", 0.0)] * len(texts)
        if self.held > CACHED_CHARS:
            self.forget()
        rows = [normalised(t) if t else [] for t in texts]
        known = self.known
        self.learn(list({w for w in chain.from_iterable(rows) if w not in known}))
        out = []
        for row in rows:
            total = self.counts[np.fromiter(map(known.__getitem__, row), np.int64, len(row))].sum(axis=0)
            if not total[-1]:
                out.append(("und", 0.0))
                continue
            bits = total[:-1] * self.weights / total[-1]
            best = int(bits.argmin())
            rest = np.delete(bits, best)
            score = 1.0 if not len(rest) else 1.0 - bits[best] / rest.min() if rest.min() > 0 else 0.0
            out.append((self.names[best], float(min(1.0, max(0.0, score)))))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """The bounded sample of labelled text for each language, words joined by spaces."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = named.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    labelled = labelled.select("doc_id", "lang", F.col("text").alias("part")).where(F.col("part").rlike(r"\p{L}"))
    n_languages = labelled.select("lang").distinct().count()
    n_docs = max(1, min(SAMPLE_DOCS, ALL_DOCS // max(1, n_languages)))
    sized = labelled.select("doc_id", "lang", F.length("part").cast("long").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.col("size") > LONG_TEXT, F.xxhash64("doc_id"), "doc_id", "size")
    picked = sized.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_docs)
    upto = F.sum("size").over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = picked.withColumn("upto", upto).where((F.col("place") == 1) | (F.col("upto") <= SAMPLE_CHARS))
    # at most SAMPLE_DOCS rows for each language
    ids = picked.select("doc_id", "lang", "size").distinct().collect()
    keys = ["doc_id", "lang", "size"]
    whole = labelled.withColumn("size", F.length("part").cast("long"))
    wanted = docs.sparkSession.createDataFrame(ids, whole.select(*keys).schema)
    chosen = whole.join(F.broadcast(wanted), keys, "left_semi").select("doc_id", "lang", "part")
    parts: dict[str, list] = {}
    for r in chosen.distinct().collect():
        parts.setdefault(r["lang"], []).append((r["doc_id"], r["part"]))
    words = {name: [w for _, part in sorted(rows) for w in normalised(part)] for name, rows in parts.items()}
    return {name: f" {' '.join(own)} " for name, own in words.items() if own}


_models: dict[int, LanguageModel] = {}


def _model(samples: dict[str, str]) -> LanguageModel:
    """One model, and so one cache, for each worker process."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _models:
        _models.clear()
        _models[key] = LanguageModel(samples)
    return _models[key]


SLICE = 1 << 22  # characters looked at at once


def language_column(docs: DataFrame, text: Column, samples: dict[str, str]) -> Column:
    """``struct<lang_pred, score>`` of a text."""
    ready_workers(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(samples)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identified(texts: pa.Array) -> pa.Array:
        model = _model(data.value)
        out: list[tuple[str, float]] = []
        part: list[str | None] = []
        held = 0
        for value in texts:
            part.append(value.as_py())
            held += len(part[-1] or "")
            if held >= SLICE:
                out += model.predict(part)
                part, held = [], 0
        out += model.predict(part)
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["lang_pred", "score"]
        )

    return identified(text)


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score (how far the second language is behind, 0 to 1)."""
    samples = language_samples(docs, doc_id, text, lang)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_column(docs, F.col("text"), samples).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )
