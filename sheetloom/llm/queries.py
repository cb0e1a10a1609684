"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.catalog.inputs import Query
from sheetloom.llm.chat_format import PART, format_chats
from sheetloom.llm.language_id import identify_languages
from sheetloom.llm.license_scan import license_report
from sheetloom.llm.line_dedup import MIN_CHARS, drop_repeated_lines
from sheetloom.llm.near_dup import near_duplicates
from sheetloom.llm.pieces import read_model, token_report
from sheetloom.llm.pii import pii_report
from sheetloom.llm.prefix_trie import branched, numbered_turns, trie_nodes
from sheetloom.llm.quality_rules import PUNCTUATION, RULES, STOP_WORD_LANGUAGES, STOP_WORDS, UNKNOWN_LANGUAGES, quality_report
from sheetloom.llm.source_mix import mix_report
from sheetloom.llm.substring_dedup import remove_repeats
from sheetloom.llm.turn_repair import DELETE, INSERT, REROLE, TRUNCATED, repair_report
from sheetloom.llm.vector_search import top_k
from sheetloom.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(path: str | None = None) -> bytes:
    """A model file; without a path the 32,000-piece vocabulary of the installed package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return read_model(path)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


OP3_SQL = f"""
WITH chats AS (
  SELECT conv_id, list({{'r': COALESCE(role, ''), 't': COALESCE(text, '')}} ORDER BY turn NULLS LAST, COALESCE(role, '')) AS s
  FROM conversations GROUP BY conv_id),
kept AS (
  SELECT conv_id, s, (SELECT COUNT(*) FROM chats c WHERE c.s = a.s) AS n_equal FROM chats a
  WHERE NOT EXISTS (SELECT 1 FROM chats b WHERE len(b.s) > len(a.s) AND b.s[1:len(a.s)] = a.s)
    AND NOT EXISTS (SELECT 1 FROM chats b WHERE b.conv_id < a.conv_id AND b.s = a.s)),
parts AS (
  SELECT conv_id, n_equal, p AS part, s[p * {PART} + 1 : (p + 1) * {PART}] AS s
  FROM kept, LATERAL (SELECT unnest(range(0, (len(s) + {PART} - 1) // {PART})) AS p))
SELECT conv_id, part, len(s)::BIGINT AS n_turns, n_equal,
       array_to_string(list_transform(s, lambda x: '<|' || x.r || '|>' || chr(10) || replace(x.t, '<|', '< |') || '<|end|>' || chr(10)), '') AS chat
FROM parts
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_table(spark, sf_dir, "documents"), piece_model())


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


#: Unlike the engine's hashes, this joins whole windows as text.
OP8_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p + 1 : p + 13], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 12)) AS p FROM w WHERE len(words) >= 13)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, MIN(doc_id) OVER (PARTITION BY content) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM later),
lists AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, COALESCE(len(places), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE
         [x FOR x, i IN words IF NOT list_contains(places, i - 1)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""


_RATIOS = {
    "n_words": "n_words",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "alpha_ratio": "n_letters / greatest(word_chars, 1)",
    "upper_ratio": "n_upper / greatest(n_letters, 1)",
    "stop_ratio": "n_stop / greatest(n_words, 1)",
}
_BROKEN = " OR ".join(
    f"(n_words >= {r.min_words} AND ({_RATIOS[r.metric]}) {sign} {limit}{' AND stop_words_apply' if r.metric == 'stop_ratio' else ''})"
    for r in RULES
    for sign, limit in (("<", r.low), (">", r.high))
    if limit is not None
)

_QUOTED_PUNCTUATION = PUNCTUATION.replace("'", "''")
_LISTED, _UNKNOWN = (", ".join(f"'{x}'" for x in names) for names in (STOP_WORD_LANGUAGES, UNKNOWN_LANGUAGES))

OP7_SQL = f"""
WITH w AS (
  SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         COALESCE(lower(regexp_extract(trim(lang), '^[^-_]*', 0)), '') AS label,
         list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(words[p + 1 : p + 8], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 7)) AS p FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, COUNT(*) OVER (PARTITION BY doc_id, content) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, COUNT(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM twice) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, COALESCE(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(trim(x, '{_QUOTED_PUNCTUATION}')) IN ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop,
         label, length(regexp_replace(t, '[^\\p{{Latin}}]', '', 'g')) AS n_latin, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, 2 * n_latin >= n_letters AND (label IN ({_LISTED}) OR (label IN ({_UNKNOWN}) AND n_stop > 0)) AS stop_words_apply,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_BROKEN}) AS kept FROM judged
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_table(spark, sf_dir, "documents")).drop("n_detections")


#: Domains of the sources, the same text for both engines.
DOMAIN = """CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'web'
     WHEN source IN ('src10', 'src11', 'src12', 'src13', 'src14') THEN 'reference' ELSE 'forum' END"""
MIX_WEIGHTS = {("web",): 5, ("reference",): 3, ("forum",): 2} | {
    (domain, lang): weight
    for domain in ("web", "reference", "forum")
    for lang, weight in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))
}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 3, 7


def mix_keys() -> dict:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(
        _table(spark, sf_dir, "documents"), mix_keys(), MIX_WEIGHTS, percent=MIX_PERCENT, max_epochs=MIX_EPOCHS, seed=MIX_SEED
    )


def _dealt(level: str, nodes: str, parent: str, name: str) -> str:
    """SQL that deals ``budget`` among siblings: the common tables `level`_left, `level`_marked and `level`."""
    return f"""
{level}_left AS (
  SELECT *, budget - COALESCE(SUM(capacity) OVER (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {name}
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         SUM(weight) OVER (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {name}
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unfilled
  FROM ({nodes})),
{level}_marked AS (SELECT *, capacity * unfilled <= remaining * weight AS filled FROM {level}_left),
{level} AS (
  SELECT *, CASE WHEN filled THEN capacity
                 ELSE (MAX(remaining) FILTER (NOT filled) OVER (PARTITION BY {parent}) * weight)
                      // MAX(unfilled) FILTER (NOT filled) OVER (PARTITION BY {parent}) END AS share
  FROM {level}_marked)"""


OP10_SQL = f"""
WITH counted AS (
  SELECT doc_id, {DOMAIN} AS domain, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS HUGEINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, SUM(tokens)::HUGEINT AS tokens FROM counted GROUP BY ALL),
{_dealt("d1", f"""SELECT domain, (SUM(tokens) * {MIX_EPOCHS})::HUGEINT AS capacity, CAST(CASE domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 ELSE 2 END AS HUGEINT) AS weight,
   (SELECT SUM(tokens) * {MIX_PERCENT} // 100 FROM leaves)::HUGEINT AS budget FROM leaves GROUP BY domain""", "1", "domain")},
{_dealt("d2", f"""SELECT l.*, d1.share::HUGEINT AS budget FROM (SELECT domain, lang, (SUM(tokens) * {MIX_EPOCHS})::HUGEINT AS capacity,
   CAST(CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS HUGEINT) AS weight FROM leaves GROUP BY domain, lang) l JOIN d1 USING (domain)""", "domain", "lang")},
{_dealt("d3", f"""SELECT l.*, d2.share::HUGEINT AS budget FROM (SELECT domain, lang, source, (tokens * {MIX_EPOCHS})::HUGEINT AS capacity,
   1::HUGEINT AS weight FROM leaves) l JOIN d2 USING (domain, lang)""", "domain, lang", "source")},
begun AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs,
         CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS left_over
  FROM leaves JOIN d3 USING (domain, lang, source)),
placed AS (
  SELECT c.*, epochs, left_over, md5(concat_ws(':', '{MIX_SEED}', epochs::VARCHAR, doc_id::VARCHAR)) AS place
  FROM counted c JOIN begun USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens::BIGINT AS n_tokens,
       (epochs + CASE WHEN SUM(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) <= left_over THEN 1 ELSE 0 END)::BIGINT AS n_copies
FROM placed
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(branched(materialize(numbered_turns(_table(spark, sf_dir, "conversations")), "trie-numbered")))


#: CRC-32 of text, as DuckDB has none: eight halvings for each byte.
CRC32 = """
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({0})), lambda i: ascii(substr({0}, i + 1, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an expression of ASCII text."""
    return f"xor({CRC32.format(text)}, 4294967295)"


#: A turn's digest, which settles the order of turns with one number.
TURN_DIGEST = "md5(length({role})::VARCHAR || ':' || {role} || {text})"

OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
chats AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, {TURN_DIGEST.format(role="role", text="text")}) AS s FROM t GROUP BY conv_id),
taken AS (SELECT conv_id, s, ({crc32_sql("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM chats),
built AS (
  SELECT a.conv_id, list_concat(COALESCE(b.s[1 : a.h], []), a.s[a.h + 1 :]) AS s
  FROM taken a LEFT JOIN chats b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (SELECT conv_id, d, s[1 : d] AS p, len(s) = d AS is_end, COALESCE(length(s[d].t), 0) AS size
             FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, p, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MIN(size) AS size,
         sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
childs AS (SELECT a.d, a.p, MIN(b.conv_id) AS up, COUNT(c.d) AS n_children
           FROM nodes a LEFT JOIN nodes b ON b.d = a.d - 1 AND b.p = a.p[1 : a.d - 1] LEFT JOIN nodes c ON c.d = a.d + 1 AND c.p[1 : a.d] = a.p
           GROUP BY a.d, a.p),
whole AS (SELECT * FROM nodes JOIN childs USING (d, p)),
above AS (SELECT d, p, n_convs, size, n_children, unnest(range(0, d + 1)) AS k FROM whole),
sums AS (SELECT k AS d, p[1 : k] AS p, SUM(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM((n_convs - 1) * size) AS saved FROM above GROUP BY ALL)
SELECT conv_id, d AS depth, up AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM whole JOIN sums USING (d, p)
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(_table(spark, sf_dir, "conversations"))


#: Unlike the engine's table of lengths, this walks a conversation's rows through the states of the grammar:
#: S start, P after the system turn, A before an assistant's turn, U after one.
OP12_SQL = f"""
WITH RECURSIVE
t AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         ({crc32_sql("(conv_id::VARCHAR || ':' || COALESCE(turn::VARCHAR, ' '))")} % 20)::BIGINT AS kind
  FROM conversations WHERE conv_id IS NOT NULL),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS time
  FROM t),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {TURN_DIGEST.format(role="role", text="text")}, time) AS i FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut
  FROM placed),
rows AS (
  SELECT conv_id, turn, role, text, i, initial, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated,
         initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) NOT IN ('su', 'ua', 'au') AS illegal
  FROM judged),
counted AS (
  SELECT conv_id, COUNT(*) AS n, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (blank) AS blank,
         COUNT(*) FILTER (duplicate) AS duplicate, COUNT(*) FILTER (truncated) AS truncated, COUNT(*) FILTER (illegal) AS illegal
  FROM rows GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, state, {{'c': {INSERT}::BIGINT * k, 'a': repeat('I', k)}} AS best
  FROM counted, (VALUES ('S', 0), ('A', 1), ('U', 2)) AS v(state, k)
  UNION ALL
  SELECT conv_id, i, state, MIN({{'c': c, 'a': a}}) AS best FROM (
    SELECT conv_id, i, c + {INSERT} * k AS c, a || repeat('I', k) AS a,
           CASE WHEN k = 0 THEN state WHEN (k % 2 = 1) = (state = 'A') THEN 'U' ELSE 'A' END AS state
    FROM (
      SELECT w.conv_id, r.i, w.best.c + {DELETE} AS c, w.best.a || 'D' AS a, w.state
      FROM walk w JOIN rows r ON r.conv_id = w.conv_id AND r.i = w.i + 1
      UNION ALL
      SELECT w.conv_id, r.i, w.best.c + CASE WHEN kept THEN 0 ELSE {REROLE} END + CASE WHEN r.truncated THEN {TRUNCATED} ELSE 0 END,
             w.best.a || CASE WHEN kept THEN 'K' ELSE 'R' END, CASE WHEN w.state = 'A' THEN 'U' ELSE 'A' END
      FROM (SELECT w.*, r.initial = CASE WHEN w.state = 'A' THEN 'a' ELSE 'u' END AS kept
            FROM walk w JOIN rows r ON r.conv_id = w.conv_id AND r.i = w.i + 1) w
      JOIN rows r ON r.conv_id = w.conv_id AND r.i = w.i + 1 AND NOT r.blank AND NOT r.duplicate
      UNION ALL
      SELECT w.conv_id, r.i, w.best.c + CASE WHEN r.truncated THEN {TRUNCATED} ELSE 0 END, w.best.a || 'K', 'P'
      FROM walk w JOIN rows r ON r.conv_id = w.conv_id AND r.i = w.i + 1 AND NOT r.blank AND NOT r.duplicate AND r.initial = 's' AND w.state = 'S'
    ), (VALUES (0), (1), (2), (3)) AS v(k))
  GROUP BY conv_id, i, state),
done AS (
  SELECT w.conv_id, MIN(w.best) AS best FROM walk w JOIN counted c ON c.conv_id = w.conv_id AND c.n = w.i AND w.state IN ('S', 'U') GROUP BY w.conv_id),
edits AS (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, unnest(range(1, strlen(best.a) + 1)) AS p FROM done WHERE best.a <> ''),
numbered AS (
  SELECT *, COUNT(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, COUNT(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS k,
         COUNT(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS m
  FROM edits),
repaired AS (
  SELECT e.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k + m) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS shown
  FROM numbered e LEFT JOIN rows r ON r.conv_id = e.conv_id AND r.i = e.i WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT o.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, COALESCE(best.c, 0) AS cost, COALESCE(best.a, '') AS audit, sha256(COALESCE(shown, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) o
LEFT JOIN counted USING (conv_id) LEFT JOIN done USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, sf_dir, "documents")).drop("kept")


#: Unlike the engine's filters and digests, this compares whole lines as text.
OP13_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM cut),
keyed AS (
  SELECT doc_id, place, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed),
owned AS (SELECT *, MIN(doc_id) OVER (PARTITION BY key) AS least FROM keyed),
judged AS (SELECT doc_id, place, line, length(key) >= {MIN_CHARS} AND doc_id > least AS gone FROM owned)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


QUERIES: dict[str, Query] = {
    "op1_near_dedup": Query(op1_near_dedup),
    "op2_pii": Query(op2_pii),
    "op3_chat_format": Query(op3_chat_format, OP3_SQL),
    "op4_sentencepiece": Query(op4_sentencepiece),
    "op10_source_mix": Query(op10_source_mix, OP10_SQL),
    "op5_top_k": Query(op5_top_k, OP5_SQL),
    "op6_language_id": Query(op6_language_id),
    "op7_quality_rules": Query(op7_quality_rules, OP7_SQL),
    "op8_substring_dedup": Query(op8_substring_dedup, OP8_SQL),
    "op9_license_scan": Query(op9_license_scan),
    "op11_prefix_trie": Query(op11_prefix_trie, OP11_SQL),
    "op12_turn_repair": Query(op12_turn_repair, OP12_SQL),
    "op13_line_dedup": Query(op13_line_dedup, OP13_SQL),
}
