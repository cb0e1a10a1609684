"""Quality rules: a threshold table compiled into one projection.

Everything is row-local and native: no shuffle, no user function.  Texts are
read whole; a null text counts as empty.  Rows are neither merged nor
reordered, so repeated rows get equal results, and an empty table gives an
empty table.

The stop-word rule holds only documents of a language whose words are listed:
mostly Latin letters, and a label of such a language or, without a label, at
least one listed word.  Words are compared without the punctuation around them.
Other columns of the input pass through `filter_documents`
untouched; `quality_report` returns only its own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09\x0A\x0B\x0C\x0D]+"  # single characters: a bit set in Java's matcher, which ranges are not
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of seven languages.
STOP_WORDS = (
    "the of and to a in is that it for was on are as with he be at by this have from or had not are but what all were "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et un une du en que est pour qui dans par pas sur au plus ce il ne se son avec "
    "el los las y que en un una por con no para su al lo como más pero sus se del "
    "il di che e la per un una in non sono del della con da si "
    "o os as e do da em um uma para com não que se na no "
    "het een van en dat op te zijn voor niet met aan"
).split()
#: The languages of these words, as labels name them (a region or script after - or _ does not count).
STOP_WORD_LANGUAGES = ("en", "eng", "de", "deu", "ger", "fr", "fra", "fre", "es", "spa", "it", "ita", "pt", "por", "nl", "nld", "dut")
UNKNOWN_LANGUAGES = ("", "und", "unknown", "mul", "zxx")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‹›“”„‚‘’…–—·¡¿"


@dataclass(frozen=True)
class Rule:
    """A document fails when `metric` leaves ``[low, high]``; documents under `min_words` are not held to it."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("words", "n_words", low=MIN_WORDS),
    Rule("repeated_windows", "repeat_ratio", high=MAX_REPEAT_PERCENT / 100),
    Rule("mean_word_length", "mean_word_length", low=1.5, high=20),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("repeated_lines", "dup_line_ratio", high=0.6),
    Rule("letters", "alpha_ratio", low=0.5),
    Rule("capitals", "upper_ratio", high=0.7),
    Rule("stop_words", "stop_ratio", low=0.02, min_words=40),
)


def quality_metrics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with the counts and ratios that rules speak of, under ``prefix``.

    Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words,
    n_upper, n_letters, n_latin and n_repeat_words.  Repeated windows are
    found by their 64-bit hash within the row: windows are sorted with their
    position, equal neighbours are marked, and their spans united.
    """
    names = {n: f"{prefix}{n}" for n in (
        "words", "lines", "hashes", "sorted", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        "n_stop_words", "n_upper", "n_letters", "n_latin", "n_repeat_words",
    )}
    col = {k: F.col(v) for k, v in names.items()}
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumns(
        {
            names["words"]: F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
            names["lines"]: F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD)),
            names["n_upper"]: F.length(F.regexp_replace(whole, r"\P{Lu}+", "")).cast("long"),
            names["n_letters"]: F.length(F.regexp_replace(whole, r"\P{L}+", "")).cast("long"),
            names["n_latin"]: F.length(F.regexp_replace(whole, r"\P{IsLatin}+", "")).cast("long"),
            names["n_symbols"]: (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
        }
    )
    n = F.size(col["words"])
    hashed = split.withColumns(
        {
            names["n_words"]: n.cast("long"),
            names["word_chars"]: F.length(F.array_join(col["words"], "")).cast("long"),
            names["n_lines"]: F.size(col["lines"]).cast("long"),
            names["n_dup_lines"]: (F.size(col["lines"]) - F.size(F.array_distinct(col["lines"]))).cast("long"),
            names["n_stop_words"]: F.size(F.filter(col["words"], lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION))).isin(STOP_WORDS))).cast("long"),
            names["hashes"]: F.when(
                n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(col["words"], i + k) for k in range(WINDOW))))
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    repeats = F.size(col["hashes"]) > F.size(F.array_distinct(col["hashes"]))
    ordered = hashed.withColumn(
        names["sorted"],
        F.when(repeats, F.sort_array(F.transform(col["hashes"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    s, m = col["sorted"], F.size(col["sorted"])

    def same(k: Column, other: Column) -> Column:
        return F.get(s, other)["h"] == F.get(s, k)["h"]  # null beyond either end

    marked = F.filter(F.sequence(F.lit(0), m - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    starts = F.sort_array(F.transform(marked, lambda k: F.get(s, k)["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda seen, p: F.struct((seen["n"] + F.least(F.lit(WINDOW), p - seen["last"])).alias("n"), p.alias("last")),
        lambda seen: seen["n"],
    )
    counted = ordered.withColumn(names["n_repeat_words"], F.when(s.isNull(), 0).otherwise(covered).cast("long"))
    # the counts come out of a generator, so that no filter on them is moved below and computes them anew
    counts = F.struct(*(F.col(v) for k, v in names.items() if k.startswith("n_") or k == "word_chars"))
    return counted.select(*(counted[f"`{c}`"] for c in docs.columns), F.inline(F.array(counts)))


def _ratios(prefix: str) -> dict[str, Column]:
    def per(top: str, under: str) -> Column:
        return F.col(prefix + top) / F.greatest(F.col(prefix + under), F.lit(1))

    return {
        "n_words": F.col(f"{prefix}n_words"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "alpha_ratio": per("n_letters", "word_chars"),
        "upper_ratio": per("n_upper", "n_letters"),
        "stop_ratio": per("n_stop_words", "n_words"),
    }


def _stop_words_apply(prefix: str, lang: Column | None) -> Column:
    """Whether a document is in a language whose stop words are listed."""
    latin = 2 * F.col(f"{prefix}n_latin") >= F.col(f"{prefix}n_letters")
    sign = F.col(f"{prefix}n_stop_words") > 0
    if lang is None:
        return latin & sign
    label = F.coalesce(F.lower(F.regexp_extract(F.trim(lang.cast("string")), "^[^-_]*", 0)), F.lit(""))
    return latin & (label.isin(*STOP_WORD_LANGUAGES) | (label.isin(*UNKNOWN_LANGUAGES) & sign))


def compile_rules(rules: tuple[Rule, ...] = RULES, prefix: str = "", lang: Column | None = None) -> Column:
    """The names of the rules a document breaks, as one array expression; ``lang`` is the label of its language."""
    ratios = _ratios(prefix)

    def broken(rule: Rule) -> Column:
        value = ratios[rule.metric]
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        if rule.metric == "stop_ratio":
            out = out & _stop_words_apply(prefix, lang)
        return F.when(out & (F.col(f"{prefix}n_words") >= rule.min_words), F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


def quality_report(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Per row: the id, the counts, ``base_failed``, ``broken`` (rule names) and ``kept``.

    A null or empty text has no words and is not kept.  Ratios of empty
    documents are taken as zero.  The label of the language is used where the table has that column.
    """
    label = F.col(lang) if lang in docs.columns else F.lit(None)
    counted = quality_metrics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label.cast("string").alias("lang")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counted.withColumns({"base_failed": base, "broken": compile_rules(rules, lang=F.col("lang"))}).drop("text", "lang")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` that pass the base test and every rule, with their columns."""
    prefix = "__quality_"
    counted = quality_metrics(docs, text, prefix)
    base = (F.col(f"{prefix}n_words") < MIN_WORDS) | (
        100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{prefix}n_words")
    )
    label = F.col(lang) if lang in docs.columns else None
    return counted.where(~base & (F.size(compile_rules(rules, prefix, label)) == 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
