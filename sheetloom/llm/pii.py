"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are always reported.  Further kinds (iban,
ssn, secret) are reported when their score, raised by context words, reaches
`MIN_SCORE`.  Patterns start at rare anchor characters, so that a text without
them costs one search, and every step is linear in the length of the text.
Offsets are code points, ends exclusive.  A null text counts as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.batches import ready_workers

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + MORE_KINDS
MIN_SCORE = 0.5
CONTEXT = 40  # characters on either side of a span in which context words count

# The base patterns' parts.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")  # tried only where a number starts
SPACED = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
SMALL_IBAN = re.compile(r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![A-Za-z0-9])")
SMALL_IBAN_DIGITS = 10  # in lower case, words look like account numbers
SSN = re.compile(r"(?<![0-9-])[0-9]{3}([- ]?)[0-9]{2}\1[0-9]{4}(?![0-9-])")
ASSIGNED = re.compile(r"[=:]\s{0,3}[\"']?([A-Za-z0-9_\-./+=]{16,})")

SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "secret": 0.2}
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social insurance"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "passphrase", "key", "keys", "apikey", "api", "auth", "credential", "credentials"),
}
CONTEXT_BONUS = 0.4
# A context word is a whole word: "monkey" and "author" are none of them; "api_key" and "KEY2" hold one.
CONTEXT_PATTERNS = {kind: re.compile(rf"(?<![^\W\d_])(?:{'|'.join(words)})(?![^\W\d_])") for kind, words in CONTEXT_WORDS.items()}
SECRET_BITS = 2.75  # least entropy of a secret's characters
LONE_LETTERS, LONE_BITS, LONE_VOWELS = 20, 3.6, 0.25  # a secret of letters of one case is as long and as mixed, with fewer vowels than words have


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the account number's check digits fit (letters count from 10, the first four go last)."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        # what precedes this sign can be no part of the next address: it is no local character
        last = found.end() if found else at + 1
        at = text.find("@", last)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for run in SPACED.finditer(text):
        if run.end() - run.start() >= 14:
            digits = run.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(run.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def _iban_end(text: str, start: int) -> int:
    """The last word end at which the account number that starts here has fitting check digits, else -1."""
    rest = IBAN_REST.match(text, start + 4)
    end = rest.end() if rest else start
    if text[end : end + 1].isascii() and text[end : end + 1].isalnum():  # beyond the longest number: back to a word's end
        end = text.rfind(" ", start, end)
    while end > start:
        number = text[start:end].replace(" ", "")
        if len(number) < 15:
            break
        if mod97(number):
            return end
        end = text.rfind(" ", start, end)  # what follows the number may be words in capitals
    return -1


def _ibans(text: str) -> list[tuple[int, int]]:
    out, m = [], IBAN.search(text)
    while m:
        end = _iban_end(text, m.start())
        if end >= 0:
            out.append((m.start(), end))
        m = IBAN.search(text, max(end, m.end()))
    for m in SMALL_IBAN.finditer(text):
        number = m.group().replace(" ", "").upper()
        if len(number) >= 15 and sum("0" <= c <= "9" for c in number) >= SMALL_IBAN_DIGITS and mod97(number):
            out.append(m.span())
    return sorted(out)


def _ssns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SSN.finditer(text) if m.group()[:3] not in ("000", "666") and m.group()[0] != "9"]


def entropy(value: str) -> float:
    """Bits a character, by the frequencies of the characters."""
    return sum(-n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _random(piece: str) -> bool:
    """Eight or more characters with digits among letters, or with capitals among small letters: no word, name or number."""
    if len(piece) < 8 or piece.isdigit():
        return False
    head = piece.rstrip("0123456789")  # a name may end in a number
    capitals = sum(c.isupper() for c in head)  # and CamelCase has few of them
    return not head.isalpha() or len(head) < len(piece) - 4 or len(head) <= 4 * capitals <= 3 * len(head)


def secret_like(value: str) -> bool:
    """Whether a value looks drawn at random: no path or address, and a piece of it is no word, name or number."""
    if value.startswith(("/", "./", "../", "~")) or "//" in value or entropy(value) < SECRET_BITS:
        return False
    pieces = re.split(r"[-_./+=]+", value)
    if any(map(_random, pieces)):
        return True
    if len(pieces) > 1 or len(value) < LONE_LETTERS or not value.isalpha() or entropy(value) < LONE_BITS:
        return False
    return sum(c in "aeiouyAEIOUY" for c in value) < LONE_VOWELS * len(value)


def _secrets(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in ASSIGNED.finditer(text) if secret_like(m.group(1))]


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns, "secret": _secrets}
_A_DIGIT = re.compile("[0-9]").search
_ASSIGNS = re.compile("[=:]").search


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, more where a context word stands whole within `CONTEXT` characters on either side."""
    near = CONTEXT_PATTERNS[kind].search
    # one character more on the outer side tells whether a word at the edge is whole
    before, after = text[max(0, start - CONTEXT - 1) : start].lower(), text[end : end + CONTEXT + 1].lower()
    return min(1.0, SCORES[kind] + CONTEXT_BONUS * bool(near(before) or near(after)))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then by kind in the order of `KINDS`."""
    if not text:
        return []
    kinds: list[str] = []
    if "@" in text:
        kinds.append("email")
    if _A_DIGIT(text):
        kinds += ["ip", "card", "iban", "ssn"]
        if "+" in text:
            kinds.append("phone")
    if _ASSIGNS(text):
        kinds.append("secret")
    out = [(kind, a, b, score(text, kind, a, b)) for kind in kinds for a, b in FINDERS[kind](text)]
    return sorted((s for s in out if s[0] in BASE_KINDS or s[3] >= MIN_SCORE), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None) -> str | None:
    """Every found span replaced by its kind in brackets; spans that overlap or touch become one, of the first's kind."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    held: list | None = None
    for kind, a, b, _ in spans:
        if held and a <= held[2]:
            held[2] = max(held[2], b)
            continue
        if held:
            out += [text[at : held[1]], f"[{held[0].upper()}]"]
            at = held[2]
        held = [kind, a, b]
    out += [text[at : held[1]], f"[{held[0].upper()}]", text[held[2] :]]
    return "".join(out)


def spans_column(docs: DataFrame, text: Column) -> Column:
    """All spans of a text as array<struct<kind, start, end, score>>."""
    ready_workers(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([find_spans(t.as_py()) for t in texts], pa.list_(kind))

    return spans(text)


def redacted_column(docs: DataFrame, text: Column) -> Column:
    ready_workers(docs.sparkSession)

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t.as_py()) for t in texts], pa.string())

    return redacted(text)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ``spans``.  Repeated rows get equal results."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", spans_column(docs, F.col("text")).alias("spans"))


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with found spans replaced in the text; all rows and columns stay."""
    return docs.withColumn(text, redacted_column(docs, F.col(text)))


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans and the list of all spans."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs, doc_id, text).select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
