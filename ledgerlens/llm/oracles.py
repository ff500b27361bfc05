"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

from ledgerlens.llm.quality import BOILERPLATE, SENTENCE_END, Rules
from ledgerlens.llm.warc import RESOLVE_SQL

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def windows_sql(window: int = 13) -> str:
    words = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH items AS (SELECT item, ws FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {words} AS ws FROM benchmark) WHERE len(ws) > 0),
phrases AS (SELECT DISTINCT item, array_to_string(ws[i:i + size - 1], ' ') AS phrase, size
  FROM (SELECT item, ws, least(len(ws), {window}) AS size, unnest(range(1, greatest(len(ws) - {window} + 2, 2))) AS i FROM items)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS ws FROM documents),
sizes AS (SELECT DISTINCT size FROM phrases),
places AS (SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, sizes WHERE len(ws) >= size)),
found AS (SELECT r, i, p.size, item FROM places JOIN phrases p ON p.phrase = places.phrase AND p.size = places.size),
hits AS (SELECT r, count(DISTINCT at_word) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS at_word FROM found) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS own FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(own), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(own, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""


def quality_sql(rules: Rules = Rules()) -> str:
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    symbols = lambda x: f"len(regexp_extract_all({x}, '[#*$%&|<>]'))"
    boilerplate = " OR ".join(f"contains(lower(line), {_quoted(x)})" for x in BOILERPLATE)
    k = rules.window
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
words AS (SELECT r, {split('body')} AS ws FROM docs),
runs AS (SELECT r, i, array_to_string(ws[i:i + {k - 1}], ' ') AS run FROM (SELECT r, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM words WHERE len(ws) >= {k})),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM runs) WHERE c > 1),
covered AS (SELECT r, count(*) AS n_repeat FROM (SELECT DISTINCT r, unnest(range(i, i + {k})) AS place FROM again) GROUP BY r),
lines AS (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(body, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line),
measured AS (SELECT *, len({split('line')}) AS n, len(regexp_extract_all(line, {_quoted(SENTENCE_END)})) AS ends,
  strlen(line) - strlen(replace(line, '!!', '!')) AS shouts, {symbols('line')} AS marks FROM lines),
judged AS (SELECT *, CASE WHEN n < {rules.short_line} THEN ends = 0 ELSE ends * {rules.words_per_sentence} < n END
  OR shouts > {rules.shouts_per_word} * n OR marks > {rules.symbols_per_word} * n OR {boilerplate} AS bad FROM measured),
by_doc AS (SELECT r, sum(c) - count(*) AS n_dup, sum(CASE WHEN bad THEN 0 ELSE n END) AS n_good FROM judged GROUP BY r),
facts AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {symbols('body')} AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
  coalesce(n_repeat, 0) AS n_repeat_words, len(ws) - coalesce(n_good, 0) AS n_lost_words FROM docs JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN by_doc USING (r)),
based AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM facts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lost_words AS BIGINT) AS n_lost_words, base_failed, NOT base_failed AND n_lost_words <= {rules.max_lost_share} * n_words AS kept
FROM based"""


def collocations_sql(threshold: int = 100, top: int = 2000) -> str:
    body = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""
WITH pieces AS (SELECT lang, row_number() OVER () AS p, ws FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({body}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(ws) > 0),
sums AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(ws) >= size)),
counted AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= {threshold}),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE size > 1),
inside AS (SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a FROM (SELECT lang, ws, a, m, unnest(range(1, size - m + 2)) AS i
  FROM candidates, (SELECT unnest([2, 3, 4]) AS m) WHERE m < size)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates ANTI JOIN inside USING (lang, phrase, a))),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = head JOIN counted y ON y.lang = c.lang AND y.phrase = tail JOIN sums s ON s.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}"""


def ranking_sql(k: int = 10) -> str:
    terms = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH items AS (SELECT item_id, row_number() OVER () AS item, {terms} AS ts FROM benchmark),
asked AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(ts) AS term FROM items) GROUP BY item, term),
docs AS (SELECT doc_id, row_number() OVER () AS r, {terms} AS ts FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, r, len(ts) AS n FROM docs WHERE len(ts) > 0),
whole AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM sized),
counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, whole GROUP BY term),
scored AS (SELECT item, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM counted JOIN weighed USING (term) JOIN asked USING (term) JOIN sized USING (r), whole GROUP BY item, doc_id, r),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= {k}"""


CHATS_SQL = r"""
WITH chat_rows AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
named AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM chat_rows),
escaped AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(INST|SYS|ROLE)\]|(NAME|NEXT)\])', '\1\\\2\3', 'g')) AS chars,
  length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?(INST|SYS|ROLE)\]|(NAME|NEXT)\])', '\1\\\2\3', 'g')) AS role_chars,
  lag(role) OVER w AS before, lead(role) OVER w AS after FROM named WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (SELECT *, CASE WHEN before = role THEN 6 WHEN role = 'user' THEN 6 WHEN role = 'system' THEN 5 WHEN role = 'assistant' THEN 0 ELSE 12 + role_chars END
  + CASE WHEN after = role THEN 0 WHEN role = 'user' THEN 7 WHEN role = 'system' THEN 6 WHEN role = 'assistant' THEN 4 ELSE 7 END AS marks FROM escaped),
whole AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS trained, 3 + sum(chars + marks) AS formatted_chars FROM marked GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(spoken) AS turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM whole"""

ORACLES: dict[str, str] = {
    "op3_warc": RESOLVE_SQL,
    "op5_fm_index": windows_sql(),
    "op7_quality": quality_sql(),
    "op11_chat": CHATS_SQL,
    "op12_reversed_search": ranking_sql(),
    "op13_phrases": collocations_sql(),
}
