"""DuckDB SQL of the operators that SQL can express on small tables.

Thresholds and fixed values come from the operators' modules, so both sides
follow one definition.
"""

from __future__ import annotations

from strandlake.llm import divergence, licenses, url_reputation

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _jensen_shannon(p: str, q: str) -> str:
    """Distance of two lists of shares."""
    def half(x, y):
        return f"CASE WHEN {x}[i + 1] > 0 THEN 0.5::DOUBLE * {x}[i + 1] * log2(2 * {x}[i + 1] / ({x}[i + 1] + {y}[i + 1])) ELSE 0.0::DOUBLE END"

    return f"sqrt(greatest(list_sum(list_transform(range(len({p})), lambda i: {half(p, q)} + {half(q, p)})), 0))"


def divergence_sql() -> str:
    d = divergence
    classes = {
        "lower": "[^a-z]+", "other": r"[\x00-\x7F]+", "upper": "[^A-Z]+", "space": r"[^\x20\x09-\x0D]+", "symbol": "[^#*$%&|<>]+", "digit": "[^0-9]+",
    }
    counts = [f"length(regexp_replace(t, '{p}', '', 'g')) AS c_{n}" for n, p in classes.items()]
    mark = "length(t) - " + " - ".join(f"c_{n}" for n in classes) + " AS c_mark"
    names = [f"c_{n}" for n in (*classes, "mark")]
    return f"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
),
counted AS (SELECT *, len(words) AS n, {', '.join(counts)} FROM base),
classed AS (SELECT *, {mark} FROM counted),
wins AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + {d.WINDOW}], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(greatest(n - {d.WINDOW - 1}, 0))) AS i FROM classed)
),
twice AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + {d.WINDOW})) AS p FROM twice) GROUP BY 1),
langs AS (
  SELECT lang, count(*) AS docs, sum(n) AS words, {', '.join(f'sum({c}) AS {c}' for c in names)}, sum(length(t)) AS chars
  FROM classed WHERE lang IS NOT NULL GROUP BY lang
),
wide AS (SELECT * FROM langs WHERE words >= {d.REFERENCE_WORDS} ORDER BY words DESC, lang LIMIT {d.LANGUAGES}),
tokens AS (SELECT lang, unnest(regexp_split_to_array(t, '{_SPACE}')) AS w FROM base WHERE lang IN (SELECT lang FROM wide)),
top AS (
  SELECT lang, w, count(*) AS c FROM tokens WHERE w <> '' GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) <= {d.TOP}
),
vocab AS (SELECT list(w ORDER BY w) AS v FROM (SELECT DISTINCT w FROM top)),
shares AS (
  SELECT lang, list(coalesce(c / CAST(words AS DOUBLE), 0) ORDER BY w) AS s
  FROM (SELECT lang, words, unnest(v) AS w FROM wide, vocab) LEFT JOIN top USING (lang, w) GROUP BY lang
),
refs AS (
  SELECT lang, list_append(s, greatest(0, 1 - list_sum(s))) AS ws, [{', '.join(f'{c} / CAST(greatest(chars, 1) AS DOUBLE)' for c in names)}] AS cs
  FROM wide JOIN shares USING (lang)
),
units AS (SELECT *, {_jensen_shannon('list_append(list_transform(s0, lambda x: 0.0::DOUBLE), 1.0::DOUBLE)', 'ws')} AS unit FROM (SELECT *, ws[:-2] AS s0 FROM refs)),
docs AS (
  SELECT doc_id, n, length(t) AS chars, [{', '.join(f'{c} / CAST(length(t) AS DOUBLE)' for c in names)}] AS cp,
    list_transform(v, lambda x: len(list_filter(words, lambda y: y = x)) / CAST(n AS DOUBLE)) AS wp
  FROM classed, vocab WHERE n >= {d.MIN_WORDS} OR length(t) >= {d.MIN_CHARS}
),
full_docs AS (SELECT *, list_append(wp, greatest(0, 1 - list_sum(wp))) AS wq FROM docs),
near AS (
  SELECT doc_id, min(CASE WHEN n >= {d.MIN_WORDS} THEN {_jensen_shannon('wq', 'ws')} / unit END) AS word_distance,
    min(CASE WHEN chars >= {d.MIN_CHARS} THEN {_jensen_shannon('cp', 'cs')} END) AS char_distance
  FROM full_docs, units GROUP BY doc_id
)
SELECT doc_id, n AS n_words, CAST(length(t) - c_space AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  n < {d.MIN_BASE_WORDS} OR 100 * coalesce(n_repeat, 0) > {d.MAX_REPEAT_PERCENT} * n AS base_failed,
  round(word_distance, 9) AS word_distance, round(char_distance, 9) AS char_distance,
  NOT (n < {d.MIN_BASE_WORDS} OR 100 * coalesce(n_repeat, 0) > {d.MAX_REPEAT_PERCENT} * n)
    AND (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM wide)
      OR coalesce(word_distance, 0) <= {d.MAX_WORD_DISTANCE} AND coalesce(char_distance, 0) <= {d.MAX_CHAR_DISTANCE}) AS kept
FROM classed LEFT JOIN again USING (doc_id) LEFT JOIN near USING (doc_id)"""


def reputation_sql() -> str:
    u = url_reputation

    def fits(rule):
        host, _, path = rule.partition("/")
        return f"(host = {_text(host)} OR ends_with(host, {_text('.' + host)})) AND starts_with(path, {_text('/' + path)})"

    ordered = sorted(u.RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_text(r)}" for _, r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_text(v)}" for v, r in ordered) + " END"
    generic, shared = (", ".join(map(_text, x)) for x in (u.GENERIC, u.SHARED))

    def level(name: str, source: str, prior: str) -> str:
        m = f"greatest(least({prior}, 1 - 1e-6), 1e-6)"
        return f"""
{name}_m AS (
  SELECT sum(n) AS w, sum(n * pow(bad / CAST(n AS DOUBLE) - {m}, 2)) AS d, sum({m} * (1 - {m})) AS chance, sum(n * {m} * (1 - {m})) AS m
  FROM {source} WHERE n > 1
),
{name}_k AS (
  SELECT CASE WHEN w > 0 AND (d - chance) / w > 0 THEN least(greatest(m / w / ((d - chance) / w) - 1, {u.WEAKEST}), {u.STRONGEST}) ELSE {u.STRONGEST} END AS k FROM {name}_m
),
{name} AS (SELECT *, (bad + k * {prior}) / (n + k) AS rate, n + k AS sure FROM {source}, {name}_k)"""

    return f"""
WITH split AS (
  SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
),
stripped AS (SELECT host, regexp_replace(coalesce(html, ''), '(?is)<(?:script|style)\\b[^<>]*>.*?(?:</(?:script|style)|\\z)', ' ', 'g') AS v FROM p),
seen AS (SELECT host, regexp_replace(regexp_replace(v, '<[^<>]*>', ' ', 'g'), '&#?[A-Za-z0-9]{{1,31}};', ' ', 'g') AS v FROM stripped),
marks AS (SELECT host, v, regexp_replace(v, '\\p{{L}}+', '', 'g') AS m FROM seen),
sizes AS (
  SELECT host, len(regexp_extract_all(v, '\\p{{L}}')) AS letters, length(m) - length(regexp_replace(m, '[#*$%&|<>!]+', '', 'g')) AS signs,
    length(regexp_replace(v, '[\\x20\\x09-\\x0D]+', '', 'g')) AS solid FROM marks
),
outcomes AS (SELECT host, CAST(letters < 10 OR 100 * signs > 8 * solid AS INT) AS bad FROM sizes),
hosts0 AS (
  SELECT host, count(*) AS n, sum(bad) AS bad, regexp_replace(host, '^.*@|:[0-9]*$|\\.+$', '', 'g') AS plain FROM outcomes WHERE host <> '' GROUP BY host
),
hosts1 AS (SELECT *, string_split(plain, '.') AS l, regexp_matches(plain, '^[0-9]+(\\.[0-9]+){{3}}$|^\\[') AS num FROM hosts0),
hosts2 AS (
  SELECT *, array_to_string(l[-2:], '.') AS two,
    coalesce(regexp_full_match(l[-1], '[a-z]{{2}}') AND l[-2] IN ({generic}), false) OR array_to_string(l[-2:], '.') IN ({shared}) AS deep FROM hosts1
),
hosts AS (
  SELECT host, n, bad, CASE WHEN num THEN 'ip' WHEN deep THEN two ELSE l[-1] END AS suffix,
    CASE WHEN num THEN plain WHEN deep THEN array_to_string(l[-3:], '.') ELSE two END AS domain FROM hosts2
),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
suffixes AS (SELECT *, (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) FROM suffixes0) AS p0 FROM suffixes0),
{level('top', 'suffixes', 'p0')},
domains1 AS (SELECT d.*, t.rate AS p1 FROM domains d JOIN top t USING (suffix)),
{level('mid', 'domains1', 'p1')},
hosts3 AS (SELECT h.*, m.rate AS p2 FROM hosts h JOIN mid m USING (suffix, domain)),
{level('low', 'hosts3', 'p2')},
bounds AS (SELECT host, rate - {u.DEVIATIONS} * sqrt(rate * (1 - rate) / (sure + 1)) AS bound FROM low)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN bound > {u.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  round(bound, 9) AS bound
FROM p LEFT JOIN bounds USING (host)"""


NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS words FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(CASE WHEN len(words) = 0 THEN 0 ELSE greatest(len(words) - 3, 1) END),
    lambda i: array_to_string(words[i + 1:i + 4], ' '))) AS s FROM w
),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
),
e AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
lab(node, label) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT e.u, min(l.label) FROM e JOIN lab l ON l.node = e.v JOIN recurring.lab m ON m.node = e.u WHERE l.label < m.label GROUP BY e.u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, label AS component_id, doc_id = label AS kept FROM sets JOIN lab ON node = doc_id"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAKS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[i + 1:i + 10], ' ') AS win
  FROM (SELECT item, words, unnest(range(greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)
),
lengths AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(words[i + 1:i + size], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(greatest(len(words) - size + 1, 0))) AS i FROM d, lengths)
),
hits AS (SELECT doc_id, i, p.size, item FROM places p JOIN windows w ON p.win = w.win AND p.size = w.size),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def licenses_sql() -> str:
    rows = ", ".join(f"({_text(name)}, {_text(licenses.normal(text))})" for name, text in licenses.TEMPLATES)
    grams = "list_distinct(list_transform(range(len({w}) - 1), lambda i: {w}[i + 1] || ' ' || {w}[i + 2]))"
    return rf"""
WITH texts AS (SELECT * FROM (VALUES {rows}) v(name, text)),
templates AS (SELECT name, {grams.format(w='w')} AS g FROM (SELECT name, string_split(text, ' ') AS w FROM texts)),
flat AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS f FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(f, chr(10))) AS u FROM flat
  UNION ALL SELECT doc_id, u FROM (SELECT doc_id, unnest(regexp_split_to_array(f, '\n[ \n]*\n')) AS u FROM flat) WHERE contains(u, chr(10))
  UNION ALL SELECT doc_id, f FROM flat WHERE contains(f, chr(10))
),
trimmed AS (SELECT DISTINCT doc_id, trim(regexp_replace(u, '[ \n]+', ' ', 'g')) AS u FROM units),
sets AS (SELECT doc_id, u, {grams.format(w='w')} AS g FROM (SELECT doc_id, u, string_split(u, ' ') AS w FROM trimmed) WHERE len(w) > 1),
scored AS (SELECT doc_id, u, name, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice FROM sets s, templates t),
hits AS (SELECT * FROM scored WHERE dice >= {licenses.THRESHOLD}),
best AS (SELECT doc_id, name, dice FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) = 1),
found AS (SELECT doc_id, count(DISTINCT u) AS n_units FROM hits GROUP BY 1),
named AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, name FROM hits) GROUP BY 1)
SELECT doc_id, name AS license, round(dice, 9) AS dice, coalesce(names, '') AS licenses, coalesce(n_units, 0) AS n_units
FROM flat LEFT JOIN best USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN named USING (doc_id)"""


AUDIT_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
counts AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(s.n, 0) AS HUGEINT) AS n, CAST(k.n AS HUGEINT) AS all_n, CAST(z.v AS HUGEINT) AS v
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes z ON z.lang = g.lang
  LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
),
shares AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
    1 + 1000000000::HUGEINT * (all_n + 5) // (sum(all_n) OVER (PARTITION BY lang, source) + 5 * v) AS q FROM counts
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50"""


ORACLE_SQL = {
    "op1_distribution_divergence": divergence_sql(),
    "op3_url_reputation": reputation_sql(),
    "op7_near_duplicates": NEAR_SQL,
    "op8_decontaminate": LEAKS_SQL,
    "op10_license_scan": licenses_sql(),
    "op12_source_audit": AUDIT_SQL,
}
