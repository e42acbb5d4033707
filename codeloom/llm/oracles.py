"""SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from codeloom.llm.licenses import TEMPLATES
from codeloom.llm.words import BASE, BYTE_VALUES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_WORDS = _words("text")

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
found AS (SELECT doc_id, places.n, i, item_id FROM places JOIN win ON win.g = places.g AND win.n = places.n),
hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) - 1 AS k FROM found),
runs AS (SELECT doc_id, min(k) AS a, max(k) + 1 AS b FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM hits) GROUP BY doc_id, run),
hit AS (SELECT doc_id, sum(b - a) AS n_hit, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM runs GROUP BY 1),
d3 AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
b3 AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT row_number() OVER () AS r, w FROM b))),
diagonals AS (SELECT doc_id, r, d3.i - b3.i AS diagonal, d3.i FROM d3 JOIN b3 USING (g)),
longest AS (SELECT doc_id, max(n) + 2 AS n FROM (SELECT doc_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, diagonal ORDER BY i) AS run FROM diagonals) GROUP BY doc_id, r, diagonal, run) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest.n, 0)::BIGINT AS longest_match, coalesce(spans, '') AS spans
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN longest ON longest.doc_id = d.doc_id"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, doc_id::HUGEINT * 1000000000 + i AS pos, md5_number(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d)),
later AS (SELECT doc_id, i FROM p JOIN (SELECT h, min(pos) AS first_pos FROM p GROUP BY 1) AS f ON f.h = p.h WHERE pos > first_pos),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k),
pieces AS (SELECT spans.doc_id, a, b, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY spans.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY spans.doc_id ORDER BY a), 0))) AS piece FROM spans JOIN d ON d.doc_id = spans.doc_id),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(piece, '' ORDER BY a) AS head, max(b) AS last FROM pieces GROUP BY 1)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 5 * n_both >= 4 * (x.n + y.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY 1),
copies AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY w) END AS copy_of FROM d)
SELECT d.doc_id, copy_of, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM d JOIN copies USING (doc_id) JOIN classes USING (doc_id) LEFT JOIN counts USING (doc_id)"""

# Rules of the quality operator: (vote for good, vote for bad), the latter first.
_RULES = (
    ("n_words >= 100", "n_words < 50"),
    ("word_chars / m BETWEEN 3 AND 10", "word_chars / m < 2 OR word_chars / m > 14"),
    ("n_symbols / m <= 0.02", "n_symbols / m > 0.1"),
    ("n_symbols / c <= 0.005", "n_symbols / c > 0.03"),
    ("n_short / m >= 0.1", "n_short / m < 0.04"),
    ("n_dup_lines / greatest(n_lines, 1) <= 0.05", "n_dup_lines / greatest(n_lines, 1) > 0.3"),
    ("n_repeat_words / m <= 0.1", "n_repeat_words / m > 0.3"),
    ("n_stops / m BETWEEN 0.02 AND 0.5", "n_stops / m < 0.002"),
    ("n_digits / c <= 0.05", "n_digits / c > 0.2"),
)


def _each(form: str, between: str = ", ") -> str:
    return between.join(form.format(j=j) for j in range(len(_RULES)))


_ODDS = "ln(prior / (1 - prior)) + " + _each("CASE v{j} WHEN 1 THEN ln(g{j} / (1 - b{j})) WHEN 0 THEN ln((1 - g{j}) / b{j}) ELSE 0 END", " + ")

#: The rounds of expectation-maximisation are the steps of a recursive query over the counts of vote patterns.
QUALITY = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM again) GROUP BY 1),
sig AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[.!?]'))::BIGINT AS n_stops,
  len(regexp_extract_all(t, '[0-9]'))::BIGINT AS n_digits, len([x FOR x IN w IF regexp_matches(x, '^\p{{L}}{{1,3}}$')]) AS n_short FROM w LEFT JOIN rep USING (r)),
sized AS (SELECT *, greatest(n_words, 1) AS m, greatest(word_chars, 1) AS c FROM sig),
votes AS (SELECT *, {", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END AS v{j}" for j, (good, bad) in enumerate(_RULES))} FROM sized),
pat AS (SELECT {_each("v{j}")}, count(*) AS n FROM votes GROUP BY ALL),
em AS (
  SELECT 0 AS k, 0.9::DOUBLE AS prior, {_each("0.95::DOUBLE AS g{j}, 0.4::DOUBLE AS b{j}")}, 1::DOUBLE AS moved
  UNION ALL
  SELECT k + 1, prior2, {_each("good{j}, bad{j}")}, greatest(abs(prior2 - prior), {_each("abs(good{j} - g{j}), abs(bad{j} - b{j})")}) FROM (
    SELECT *, {_each("least(0.995, greatest(1.005 - good{j}, low{j})) AS bad{j}")} FROM (
      SELECT k, prior, {_each("g{j}, b{j}")}, least(0.995, greatest(0.5, (sum(n * p) + 0.9e-3 * sum(n)) / (1.001 * sum(n)))) AS prior2,
        {_each("least(0.995, greatest(0.55, (sum(n * p * (v{j} = 1)::INT) + 0.95e-3 * sum(n)) / (sum(n * p * (v{j} >= 0)::INT) + 1e-3 * sum(n)))) AS good{j}")},
        {_each("(sum(n * (1 - p) * (v{j} = 0)::INT) + 0.4e-3 * sum(n)) / (sum(n * (1 - p) * (v{j} >= 0)::INT) + 1e-3 * sum(n)) AS low{j}")}
      FROM (SELECT em.*, pat.*, 1 / (1 + exp(-({_ODDS}))) AS p FROM em, pat WHERE k < 300 AND moved >= 1e-7)
      GROUP BY k, prior, {_each("g{j}, b{j}")}))
),
fitted AS (SELECT * FROM em ORDER BY k DESC LIMIT 1),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({_ODDS}))) AS quality_p FROM votes, fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stops, n_digits, n_short, base_failed, quality_p, NOT base_failed AND quality_p >= 0.5 AS kept FROM judged"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in TEMPLATES.items() for text in texts)

#: Every window that begins and ends with a bigram of the template, by running counts from each beginning.
LICENSES = f"""
WITH t AS (SELECT row_number() OVER () AS i, name, {_words("body")} AS w FROM (VALUES {_TEMPLATES}) AS v(name, body)),
tb AS (SELECT DISTINCT i, name, w[k] || ' ' || w[k + 1] AS g FROM (SELECT i, name, w, unnest(range(1, len(w))) AS k FROM t)),
ts AS (SELECT i, name, count(*) AS size FROM tb GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, j - 1 AS line, {_words("lines[j]")} AS w FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS j FROM d)),
o AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY r ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM l),
wd AS (SELECT r, line, before + k - 1 AS p, w[k] AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM o)),
bg AS (SELECT *, lag(p) OVER (PARTITION BY r, g ORDER BY p) AS last FROM (SELECT r, p, lag(x) OVER (PARTITION BY r ORDER BY p) || ' ' || x AS g FROM wd) WHERE g IS NOT NULL),
own AS (SELECT r, i, p, g FROM bg JOIN tb USING (g)),
cand AS (SELECT r, i, name, size FROM (SELECT r, i, count(DISTINCT g) AS n FROM own GROUP BY ALL) JOIN ts USING (i) WHERE n >= 0.8 * size / 1.2 - 1e-9),
runs AS (SELECT c.r, c.i, c.name, c.size, s.p AS a, k.p AS y, e.p IS NOT NULL AS ends,
  sum((coalesce(k.last, -1) < s.p)::INT) OVER w AS different, sum((coalesce(k.last, -1) < s.p AND e.p IS NOT NULL)::INT) OVER w AS shared
  FROM cand AS c JOIN own AS s ON s.r = c.r AND s.i = c.i JOIN bg AS k ON k.r = c.r AND k.p >= s.p LEFT JOIN own AS e ON e.r = c.r AND e.i = c.i AND e.p = k.p
  WINDOW w AS (PARTITION BY c.r, c.i, s.p ORDER BY k.p)),
good AS (SELECT *, 2 * shared / (different + size) AS dice FROM runs WHERE ends AND 2 * shared >= (0.8 - 1e-12) * (different + size)),
tops AS (SELECT *, max(dice) OVER (PARTITION BY r, i, a) AS top FROM good),
wins AS (SELECT r, name, i, a - 1 AS a, max(y) + 1 AS b, top AS dice FROM tops WHERE dice >= top - 1e-12 GROUP BY r, name, i, a, top),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY round(dice, 12) DESC, b - a DESC, name, a, i) AS k FROM wins),
many AS (SELECT r, count(DISTINCT name) AS n FROM wins GROUP BY 1),
sizes AS (SELECT r, sum(len(w)) AS n FROM l GROUP BY 1)
SELECT d.doc_id, sizes.n::BIGINT AS n_words, best.name AS license, coalesce(round(dice, 9), 0)::DOUBLE AS dice, coalesce(many.n, 0)::BIGINT AS n_licenses,
  x.line AS first_line, z.line + 1 AS end_line, a AS first_word, b AS end_word
FROM d JOIN sizes USING (r) LEFT JOIN best ON best.r = d.r AND k = 1 LEFT JOIN many ON many.r = d.r LEFT JOIN wd AS x ON x.r = d.r AND x.p = a LEFT JOIN wd AS z ON z.r = d.r AND z.p = b - 1"""


_BYTES = ", ".join(f"('{b:02X}', {v})" for b, v in enumerate(BYTE_VALUES.tolist()))
_WRAP = "18446744073709551616::UHUGEINT"


def _mixed(table: str, keep: str) -> str:
    """``table`` with the finaliser of its column h, which wraps at 64 bits."""
    return (
        f"(SELECT {keep}, xor(h, h >> 31) AS h FROM (SELECT {keep}, (xor(h, h >> 27) * 10723151780598845931::UHUGEINT) % {_WRAP} AS h "
        f"FROM (SELECT {keep}, (xor(h, h >> 30) * 13787848793156543929::UHUGEINT) % {_WRAP} AS h FROM {table})))"
    )


#: Lines are hashed byte by byte, as powers of the base modulo 2**64, to find the borders; chunks are compared as texts.
LINE_CHUNKS = rf"""
WITH RECURSIVE low(i, p) AS (SELECT 0, 1::UHUGEINT UNION ALL SELECT i + 1, (p * {BASE}::UHUGEINT) % {_WRAP} FROM low WHERE i < 1023),
high(i, p) AS (SELECT 0, 1::UHUGEINT UNION ALL SELECT i + 1, (p * {pow(BASE, 1024, 1 << 64)}::UHUGEINT) % {_WRAP} FROM high WHERE i < 1023),
v(b, v) AS (VALUES {_BYTES}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, k, l[k] AS line, CASE WHEN k < len(l) THEN chr(10) ELSE '' END AS stop FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM d)),
full_lines AS (SELECT * FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
distinct_lines AS (SELECT row_number() OVER () AS n, line, hex(encode(line)) AS hx FROM (SELECT DISTINCT line FROM full_lines)),
b AS (SELECT n, i, substr(hx, 2 * i + 1, 2) AS b FROM (SELECT n, hx, unnest(range(0, length(hx) // 2)) AS i FROM distinct_lines)),
sums AS (SELECT n, (sum(((v.v::UHUGEINT * ((low.p * high.p) % {_WRAP})) % {_WRAP})::HUGEINT))::UHUGEINT % {_WRAP} AS h FROM b JOIN v USING (b) JOIN low ON low.i = b.i % 1024 JOIN high ON high.i = b.i // 1024 GROUP BY 1),
hashes AS (SELECT line, m.h FROM {_mixed("sums", "n")} AS m JOIN distinct_lines USING (n)),
numbered AS (SELECT r, doc_id, k, line, h, row_number() OVER (PARTITION BY r ORDER BY k) AS j, count(*) OVER (PARTITION BY r) AS n, lead(hashes.h) OVER (PARTITION BY r ORDER BY k) AS after FROM full_lines JOIN hashes USING (line)),
pairs AS (SELECT r, doc_id, k, j, n, (h * 3 + coalesce(after, 0)) % {_WRAP} AS h FROM numbered),
borders AS (SELECT * FROM {_mixed("pairs", "r, doc_id, k, j, n")} WHERE h % 4 != 0 OR j = 1 OR j = n),
chunks AS (SELECT * FROM (SELECT r, doc_id, k AS a, j AS ja, lead(k) OVER w AS b, lead(j) OVER w AS jb FROM borders WINDOW w AS (PARTITION BY r ORDER BY k)) WHERE b IS NOT NULL),
texts AS (SELECT chunks.*, array_to_string(list_slice(l, a, b), chr(10)) AS body FROM chunks JOIN d USING (r)),
repeats AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS place FROM texts) WHERE place > 1),
gone AS (SELECT DISTINCT r, unnest(range(a, b + 1)) AS k FROM repeats),
kept AS (SELECT r, string_agg(line || stop, '' ORDER BY k) AS t FROM x ANTI JOIN gone USING (r, k) GROUP BY 1),
n_lines AS (SELECT r, count(*) AS n FROM full_lines GROUP BY 1),
n_chunks AS (SELECT r, count(*) AS n FROM chunks GROUP BY 1),
n_gone AS (SELECT r, count(*) AS n FROM repeats GROUP BY 1),
n_cut AS (SELECT r, count(*) AS n FROM full_lines SEMI JOIN gone USING (r, k) GROUP BY 1)
SELECT doc_id, coalesce(n_lines.n, 0)::BIGINT AS n_lines, coalesce(n_chunks.n, 0)::BIGINT AS n_chunks, coalesce(n_gone.n, 0)::BIGINT AS n_removed_chunks, coalesce(n_cut.n, 0)::BIGINT AS n_removed_lines,
  octet_length(encode(coalesce(t, '')))::BIGINT AS n_kept_bytes, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n_lines USING (r) LEFT JOIN n_chunks USING (r) LEFT JOIN n_gone USING (r) LEFT JOIN n_cut USING (r) LEFT JOIN kept USING (r)"""

ORACLES = {
    "op1_line_dedup": LINE_CHUNKS,
    "op2_license_scan": LICENSES,
    "op3_suffix_dedup": SUBSTRINGS,
    "op6_ngram_jaccard": NEAR_DUPLICATES,
    "op9_quality_rules": QUALITY,
    "op10_decontaminate": DECONTAMINATION,
}
