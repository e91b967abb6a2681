"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_LEDGER = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts),
line_counts AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
windows AS (
  SELECT r, i, hash(list_slice(w, i, i + 7)) AS h, list_slice(w, i, i + 7) AS win
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM texts WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    (length(t) - length(replace(t, ' |', ''))) // 2 AS n_bars, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_bangs,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
  FROM texts LEFT JOIN line_counts USING (r) LEFT JOIN covered USING (r)),
ledger AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    | CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    | CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    | CASE WHEN n_words >= 20 AND 100 * n_bars > 20 * n_words THEN 16 ELSE 0 END
    | CASE WHEN n_words >= 20 AND 100 * n_upper > 60 * n_letters AND 100 * n_bangs > 20 * n_words THEN 32 ELSE 0 END
    | CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM measured)"""

ORACLES["op6_rule_ledger"] = f"""WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM ledger"""

ORACLES["op6_rule_ablations"] = f"""WITH {_LEDGER},
rules(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('many_symbols', 4), ('duplicate_lines', 8),
  ('bars_between_words', 16), ('shouting', 32), ('long_words', 64)),
policies(policy, mask) AS (VALUES ('base', 3), ('v1', 127))
SELECT policy, rule, (SELECT count(*) FROM ledger WHERE failed & bit <> 0) AS removed,
  (SELECT count(*) FROM ledger WHERE failed & mask = bit) AS removed_only_by
FROM policies, rules WHERE mask & bit <> 0"""

_WINDOWS = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS win
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM texts WHERE len(w) >= 50)),
judged AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS ref FROM windows)"""

ORACLES["op3_lempel_ziv_spans"] = f"""WITH {_WINDOWS},
gone AS (SELECT DISTINCT r, i + k AS i FROM judged, (SELECT unnest(generate_series(0, 49)) AS k) WHERE ref < doc_id),
lists AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
places AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM places ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(lists.gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)"""

ORACLES["op3_lempel_ziv_factors"] = f"""WITH {_WINDOWS},
hits AS (SELECT *, i - row_number() OVER (PARTITION BY r, ref ORDER BY i) AS run FROM judged WHERE ref < doc_id)
SELECT doc_id, (min(i) - 1)::BIGINT AS start, (count(*) + 49)::BIGINT AS length, ref AS ref_doc FROM hits GROUP BY r, doc_id, ref, run"""

ORACLES["op7_chat_templates"] = r"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
marked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt,
    replace(replace(replace(role || chr(10) || text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS shown
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(learnt))::BIGINT AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length(shown) + length('<turn></turn>') + 1)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""


def _notice_rows() -> str:
    from .licences import TEMPLATES

    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())


def _plain(column: str) -> str:
    lowered = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""list_filter(list_transform(regexp_split_to_array({lowered}, '[\x20\x09-\x0D]+'), lambda w: trim(w, '.,;:!?()"''')), lambda w: w <> '')"""


ORACLES["op8_license_scan"] = f"""WITH notices AS (SELECT name, {_plain('text')} AS w FROM (VALUES {_notice_rows()}) t(name, text)),
wanted AS (SELECT DISTINCT name, list_slice(w, i, i + 4) AS shingle FROM (SELECT name, w, unnest(generate_series(1, len(w) - 4)) AS i FROM notices)),
sized AS (SELECT name, count(*) AS m, pow(2, ceil(log2(count(*))))::BIGINT AS c FROM wanted GROUP BY name),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_plain('text')} AS w FROM documents),
parts AS (SELECT r, doc_id, i - 1 AS p, list_slice(w, i, i + 4) AS shingle FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM texts WHERE len(w) > 4)),
hits AS (SELECT r, doc_id, name, m, p, shingle, unnest([p // c, p // c - 1]) AS win FROM parts JOIN wanted USING (shingle) JOIN sized USING (name)),
held AS (SELECT r, doc_id, name, win, count(DISTINCT shingle) / m AS share, min(p) AS p FROM hits WHERE win >= 0 GROUP BY r, doc_id, name, win, m)
SELECT doc_id, name AS notice, max(share) AS containment, count(*)::BIGINT AS windows, min(p)::BIGINT AS first_word FROM held WHERE share >= 0.8 GROUP BY r, doc_id, name"""


def _short_rows() -> str:
    from .licences import SHORT

    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in SHORT.items())


ORACLES["op8_short_notices"] = f"""WITH notices AS (SELECT name, {_plain('text')} AS w FROM (VALUES {_short_rows()}) t(name, text)),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_plain('text')} AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(generate_series(1, len(w))) AS i FROM texts WHERE len(w) > 0),
places AS (SELECT r, doc_id, i - 1 AS p, list_slice(w, i, i + k - 1) AS seq FROM starts, (SELECT DISTINCT len(w) AS k FROM notices) WHERE i + k - 1 <= len(w))
SELECT doc_id, name AS notice, 1.0::DOUBLE AS containment, count(*)::BIGINT AS windows, min(p)::BIGINT AS first_word FROM places JOIN notices ON seq = notices.w GROUP BY r, doc_id, name"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op12_count_rtree"] = rf"""WITH RECURSIVE
texts AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s
  FROM texts),
-- equal sets are one
distinct_sets AS (SELECT min(r) AS d, k, any_value(len(s)) AS n, any_value(s) AS s FROM (SELECT r, s, list_sort(s) AS k FROM sets WHERE len(s) > 0) GROUP BY k),
owners AS (SELECT sets.r, sets.doc_id, d FROM sets JOIN distinct_sets ON list_sort(sets.s) = k WHERE len(sets.s) > 0),
shingles AS MATERIALIZED (SELECT d, n, unnest(s) AS g FROM distinct_sets),
shared AS (
  SELECT a.d AS a, b.d AS b, count(*) AS common, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.d < b.d AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * common >= 90 * (an + bn - common) UNION ALL SELECT b, a FROM shared WHERE 100 * common >= 90 * (an + bn - common)),
reach(d, e) AS (SELECT d, d FROM distinct_sets UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.e),
names AS (SELECT reach.d, min(owners.doc_id) AS name FROM reach JOIN owners ON owners.d = reach.e GROUP BY 1)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE name END AS component_id
FROM sets LEFT JOIN owners USING (r) LEFT JOIN names ON names.d = owners.d"""

ORACLES["op13_rabin_karp_phrases"] = rf"""WITH
pieces AS (
  SELECT row_number() OVER () AS p, lang, w FROM (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
  WHERE len(w) > 0),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
counts AS MATERIALIZED (SELECT lang, m, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
    array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS tail
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM counts WHERE m >= 2)),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f + t.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000::HUGEINT * c.a // (h.f + t.f), k) AS place
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
inside AS (
  SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), s, s + k - 1), ' ') AS phrase, max(f) AS longest
  FROM (SELECT *, unnest(generate_series(1, m - k + 1)) AS s FROM (SELECT *, unnest(generate_series(2, m - 1)) AS k FROM counts WHERE m >= 3))
  GROUP BY ALL),
kept AS (SELECT scored.* FROM scored LEFT JOIN inside USING (lang, phrase) WHERE place = 1 AND (longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
