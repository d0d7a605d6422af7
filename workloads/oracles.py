"""DuckDB SQL for the registered queries, written independently of the library.

Words are split into lists and filtered where the library uses patterns; runs
and joins are plain GROUP BY where the library works inside a row.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

NL = "chr(10)"
WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+')"


def words(text: str) -> str:
    return WORDS.format(text)


def tokens(text: str) -> str:
    return TOKENS.format(text)


def wc(text: str) -> str:
    return f"CAST(len({words(text)}) AS BIGINT)"


def sents(text: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace(replace({text}, {NL}, ' '), "
        r"'([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))"
    )


def even(value: str, digits: int) -> str:
    """Ties to even on the exact binary value of a double."""
    s, k = f"{10**digits}.0::DOUBLE", "134217729.0::DOUBLE"
    low = f"(v * {s} - floor(v * {s})) + (((v * {k} - (v * {k} - v)) * {s} - v * {s}) + (v - (v * {k} - (v * {k} - v))) * {s})"
    up = f"CASE WHEN {low} > 0.5 OR ({low} = 0.5 AND floor(v * {s}) % 2 <> 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"list_transform([CAST({value} AS DOUBLE)], lambda v: (floor(v * {s}) + {up}) / {s})[1]"


def unnested(source: str, array: str, item: str, number: str, keep: str = "doc_id") -> str:
    """Rows (keep, number, item) of an array expression over ``source``."""
    return (
        f"SELECT {keep}, unnest(a_) AS {item}, unnest(range(1, len(a_) + 1)) AS {number} "
        f"FROM (SELECT {keep}, {array} AS a_ FROM {source})"
    )


HEADED = (
    f"SELECT doc_id, lang, replace(text || {NL}, '.' || {NL}, {NL}) AS text FROM documents"
)
LINES = unnested("hd", f"string_split(text, {NL})", "line", "line_no")
HEADS = (
    "SELECT doc_id, line_no AS line, title FROM (SELECT doc_id, line_no, "
    r"trim(regexp_replace(line, '^\s*#+\s*', '')) AS title FROM ln) "
    r"WHERE regexp_matches(title, '^\p{L}') "
    r"AND NOT regexp_matches(title, '[.!?…:;,]$|[.!?…]\s') "
    f"AND len({words('title')}) <= 4"
)
SECTIONS = """
SELECT * FROM (VALUES
 ('en-report', 0, 'opening', 'Opening', true, 90, 'and ornd'),
 ('en-report', 0, 'opening', 'Opening', true, 90, 'of'),
 ('en-report', 0, 'opening', 'Opening', true, 90, 'hetible th'),
 ('en-report', 1, 'middle', 'Middle', true, NULL, 'to to'),
 ('en-report', 1, 'middle', 'Middle', true, NULL, 'thing'),
 ('en-report', 2, 'rights', 'Rights', true, 40, 'all rights reserved'),
 ('en-report', 2, 'rights', 'Rights', true, 40, 'released under the mit license'),
 ('en-report', 3, 'closing', 'Closing', false, NULL, 'the'),
 ('en-report', 3, 'closing', 'Closing', false, NULL, 'in'),
 ('de-report', 0, 'opening', 'Opening', true, 80, 'ietzte'),
 ('de-report', 0, 'opening', 'Opening', true, 80, 'stteen erachtz'),
 ('de-report', 1, 'middle', 'Middle', true, NULL, 'enststung ench'),
 ('de-report', 1, 'middle', 'Middle', true, NULL, 'und'),
 ('de-report', 2, 'rights', 'Rights', true, 40, 'all rights reserved'),
 ('de-report', 2, 'rights', 'Rights', true, 40, 'released under the mit license'),
 ('fr-report', 0, 'opening', 'Opening', true, 70, 'anquean çouê'),
 ('fr-report', 0, 'opening', 'Opening', true, 70, 'le treque'),
 ('fr-report', 1, 'middle', 'Middle', true, NULL, 'et'),
 ('fr-report', 1, 'middle', 'Middle', true, NULL, 'ench')
) AS v(profile, idx, section_id, title, required, corpus_share, variant)
"""
MARKERS = """
SELECT * FROM (VALUES
 ('shouting', 'remove', '!!+', 'one mark'),
 ('licence-line', 'remove', '(?i)(?:licensed under|all rights reserved|released under)',
  'drop the line'),
 ('secret', 'rewrite', 'token = "[0-9a-f]+"', 'remove the secret'),
 ('markup-noise', 'rewrite', '[*#%&$]{3,}', 'clean the text'),
 ('pipe', 'review', '\\|', ''),
 ('contact', 'review', '[A-Za-z0-9.]+@[A-Za-z0-9.]+', '')
) AS v(id, action, pattern, fix)
""".replace("\\\\", "\\")
DOC_LINES = unnested("documents", f"string_split(text, {NL})", "line", "line_no")


def _marker_hits() -> str:
    rules = [
        ("shouting", "remove", "!!+", "one mark"),
        ("licence-line", "remove",
         "(?i)(?:licensed under|all rights reserved|released under)", "drop the line"),
        ("secret", "rewrite", 'token = "[0-9a-f]+"', "remove the secret"),
        ("markup-noise", "rewrite", "[*#%&$]{3,}", "clean the text"),
        ("pipe", "review", r"\|", ""),
        ("contact", "review", "[A-Za-z0-9.]+@[A-Za-z0-9.]+", ""),
    ]
    parts = [
        f"SELECT doc_id, line_no, '{i}' AS id, '{a}' AS action, '{fix}' AS fix, "
        f"unnest(regexp_extract_all(line, '{p}')) AS hit FROM dl"
        for i, a, p, fix in rules
    ]
    return " UNION ALL ".join(parts)


HITS = _marker_hits()

ORACLES["front_matter"] = f"""
SELECT 'doc-' || doc_id AS doc_id, source || '.md' AS path, lang AS genre,
       'https://x/' || source AS source_url, CAST(3 AS BIGINT) AS fields,
       {wc('text')} AS words, md5(text) AS body
FROM documents
"""
ORACLES["newlines"] = """
SELECT doc_id, md5(replace(text, '. ', '.' || chr(10))) AS digest FROM documents
"""
ORACLES["section_spellings"] = f"""
WITH hd AS ({HEADED}), ln AS ({LINES}), h AS ({HEADS}), s AS ({SECTIONS})
SELECT s.profile, s.section_id, s.variant, s.required, count(DISTINCT doc_id) AS documents
FROM h JOIN s ON lower(h.title) = s.variant GROUP BY 1, 2, 3, 4
"""
ORACLES["marker_catalogue"] = f"""
WITH dl AS ({DOC_LINES}), hits AS ({HITS})
SELECT v.id, v.action, count(hits.id) AS hits
FROM (VALUES ('shouting', 'remove'), ('licence-line', 'remove'), ('secret', 'rewrite'),
             ('markup-noise', 'rewrite'), ('pipe', 'review'), ('contact', 'review')) v(id, action)
LEFT JOIN hits ON hits.id = v.id GROUP BY 1, 2
"""
ORACLES["name_snapshot"] = """
SELECT CAST(DATE '2024-01-01' + p_size AS VARCHAR) AS snapshot, count(*) AS names,
       CAST(60 - p_size AS BIGINT) AS age_days, 60 - p_size > 45 AS stale
FROM part GROUP BY p_size
"""
ORACLES["word_count"] = f"SELECT doc_id, {wc('text')} AS words FROM documents"
ORACLES["line_of"] = f"""
SELECT doc_id, CASE WHEN contains(text, ',')
         THEN CAST(len(string_split(split_part(text, ',', 1), {NL})) AS BIGINT) END AS line
FROM documents
"""
ORACLES["lines"] = DOC_LINES
ORACLES["sentences"] = f"""
SELECT *, {wc('sentence')} AS words
FROM ({unnested('documents', sents('text'), 'sentence', 'sentence_no')})
"""
ORACLES["paragraphs"] = unnested(
    "documents",
    f"list_filter(string_split(replace(text, '.' || {NL}, '.' || chr(1)), chr(1)), "
    r"lambda p: regexp_matches(p, '\S'))",
    "paragraph",
    "paragraph_no",
)
ORACLES["segments"] = f"""
WITH d AS (SELECT doc_id, replace(text, ' that ', ', but ') AS text FROM documents),
s AS ({unnested('d', sents('text'), 'sentence', 'sentence_no')}),
c AS (SELECT doc_id, sentence_no, list_filter(list_transform(string_split(
        regexp_replace(sentence, '(?i)[,;]?\\s+(but|aber|pero|mais)\\s+', chr(1), 'g'), chr(1)),
        lambda x: trim(x)), lambda x: x <> '') AS a FROM s)
SELECT doc_id, sentence_no, unnest(a) AS segment, unnest(range(1, len(a) + 1)) AS segment_no
FROM c
"""
ORACLES["tokens"] = f"""
WITH p AS (
  SELECT doc_id, unnest(a) AS piece, unnest(range(1, len(a) + 1)) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS a
        FROM documents)),
o AS (SELECT doc_id, piece, k, sum(length(piece)) OVER (
        PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(piece) AS start FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS token_no,
       CAST(start AS BIGINT) AS start, piece AS token
FROM o WHERE regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]')
"""
ORACLES["lemmas"] = f"""
WITH w AS (SELECT doc_id, lower(unnest({tokens('text')})) AS t FROM documents),
l AS (
  SELECT doc_id, t AS lemma FROM w WHERE t LIKE '%s'
  UNION ALL SELECT doc_id, t[:-2] FROM w WHERE t LIKE '%s'
  UNION ALL SELECT doc_id, regexp_replace(t, '(es|en|er|s|e)$', '') FROM w WHERE t NOT LIKE '%s')
SELECT doc_id, lemma, count(*) AS n FROM l GROUP BY 1, 2
"""
ORACLES["guessed_lemmas"] = r"""
WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS form FROM documents),
t AS (SELECT form, regexp_replace(form, '(es|en|er|s|e)$', '') AS lemma FROM f
      UNION SELECT form, form FROM f WHERE form LIKE '%s'),
sh AS (SELECT form, lemma, md5(form)[1] < '5' AS held_out,
         (SELECT max(i) FROM range(0, length(form) + 1) r(i) WHERE form[:i] = lemma[:i] AND i <= length(lemma)) AS shared FROM t),
e AS (SELECT form, length(form) - shared AS cut, lemma[shared + 1:] AS add, unnest(range(0, 6)) AS n FROM sh WHERE NOT held_out),
rule AS (SELECT right(form, n) AS ending, n, cut, add FROM e WHERE n >= cut AND n <= length(form) - 2
         GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT form) >= 2),
h AS (SELECT DISTINCT form, unnest(range(0, 6)) AS n FROM sh WHERE held_out),
m AS (SELECT h.form, rule.n, cut, add FROM h JOIN rule ON rule.n = h.n AND h.n <= length(form) - 2 AND ending = right(form, h.n)),
g AS (SELECT DISTINCT form, form[:length(form) - cut] || add AS lemma FROM m
      WHERE n = (SELECT max(n) FROM m x WHERE x.form = m.form))
SELECT form, lemma, r.form IS NOT NULL AS "right"
FROM g FULL JOIN (SELECT form, lemma FROM sh WHERE held_out) r USING (form, lemma)
"""
ORACLES["inflected_names"] = r"""
WITH d AS (SELECT doc_id, text || coalesce(chr(10) || 'Use ' || split_part(p_name, ' ', 1) || 's ' || split_part(p_name, ' ', 2)
        || 'es, or ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || '.', '') AS text
      FROM documents LEFT JOIN part ON doc_id = p_partkey),
nm AS (SELECT DISTINCT p_name AS official, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
w AS (SELECT a AS w FROM nm UNION SELECT b FROM nm),
lem AS (SELECT w AS form, w AS lemma FROM w UNION SELECT w || 's', w FROM w UNION SELECT w || 'es', w FROM w UNION SELECT w || 's', w || 's' FROM w),
p AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[.!?…]+', ' . ', 'g'),
        '[^\p{L}\p{N}\s.''’ʼ`\-–—−]+', ' , ', 'g'), '\s+'), lambda x: x <> '') AS ws FROM d),
q AS (SELECT doc_id, ws[i] AS x, ws[i + 1] AS y FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM p)
      WHERE ws[i] NOT IN ('.', ',') AND ws[i + 1] NOT IN ('.', ',')),
tk AS (SELECT x AS form FROM q UNION SELECT y FROM q),
own AS (SELECT tk.form, coalesce(lem.lemma, regexp_replace(lower(tk.form), '(es|en|er|s|e)$', '')) AS lemma
        FROM tk LEFT JOIN lem ON lem.form = lower(tk.form)),
fits AS (SELECT DISTINCT own.form, w.w FROM own JOIN lem ON lem.lemma = own.lemma JOIN w ON w.w = lem.form)
SELECT doc_id, official, x || ' ' || y AS was, count(*) AS n
FROM q JOIN fits f ON f.form = x JOIN nm ON nm.a = f.w JOIN fits g ON g.form = y AND g.w = nm.b
GROUP BY 1, 2, 3
"""
ORACLES["headings"] = f"WITH hd AS ({HEADED}), ln AS ({LINES}) {HEADS}"
ORACLES["masked_text"] = f"""
WITH hd AS (SELECT doc_id, regexp_replace(text, '(tion)( [a-z]+ )', '\\1 "\\2" ', 'g') AS text
            FROM ({HEADED})),
ln AS ({LINES}), h AS ({HEADS}),
t AS (SELECT ln.doc_id, string_agg(CASE WHEN h.line IS NULL THEN ln.line
              ELSE repeat(' ', length(ln.line)) END, {NL} ORDER BY ln.line_no) AS text
      FROM ln LEFT JOIN h ON h.doc_id = ln.doc_id AND h.line = ln.line_no GROUP BY 1),
p AS (SELECT doc_id, unnest(a) AS piece, unnest(range(1, len(a) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, '"[^"\\n]*"|License|token|[^"Lt]+|[\\s\\S]') AS a
      FROM t)),
m AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(piece, '^("[^"\\n]*"|License|token)$')
        THEN repeat(' ', length(piece)) ELSE piece END, '' ORDER BY k) AS text FROM p GROUP BY 1)
SELECT m.doc_id, CAST(length(m.text) AS BIGINT) AS length,
       length(m.text) = length(hd.text) AS same_length, md5(m.text) AS digest
FROM m JOIN hd USING (doc_id)
"""
ORACLES["strip_fence"] = """
SELECT doc_id, md5(trim(text, ' ' || chr(10))) AS fenced, md5(trim(text, ' ' || chr(10))) AS plain
FROM documents
"""
ORACLES["compact_findings"] = f"""
WITH dl AS ({DOC_LINES}), hits AS ({HITS})
SELECT doc_id, 'markers.' || id AS id,
       CASE action WHEN 'review' THEN 'review' ELSE 'likely' END AS severity, hit AS evidence,
       nullif(fix, '') AS suggestion, CAST(CASE fix WHEN '' THEN 8 ELSE 9 END AS BIGINT) AS fields
FROM hits
"""
ORACLES["checked_findings"] = """
SELECT doc_id, CASE toxic WHEN 1 THEN 'grave' ELSE 'review' END AS severity,
       CAST(quality * 0.5 + toxic AS DOUBLE) AS confidence,
       toxic <> 1 AND quality * 0.5 + toxic BETWEEN 0 AND 1 AS valid
FROM labels
"""
ORACLES["marker_hits"] = f"""
WITH dl AS ({DOC_LINES}), hits AS ({HITS})
SELECT doc_id, 'markers.' || id AS id,
       CASE action WHEN 'review' THEN 'review' ELSE 'likely' END AS severity,
       CAST(CASE action WHEN 'review' THEN 0.6 ELSE 0.8 END AS DOUBLE) AS confidence,
       hit AS evidence, line_no AS line FROM hits
"""
PAIRS = """
SELECT doc_id || '-digits' AS pair_id, doc_id, 'digits' AS edit, text AS before,
       regexp_replace(text, '[0-9]+', '', 'g') AS after FROM documents
UNION ALL SELECT doc_id || '-parentheses', doc_id, 'parentheses', text,
       regexp_replace(text, ' \\([^)]*\\)', '', 'g') FROM documents
UNION ALL SELECT doc_id || '-merged', doc_id, 'merged', text, replace(text, '. ', ', ')
FROM documents
UNION ALL SELECT doc_id || '-articles', doc_id, 'articles', text,
       regexp_replace(text, ' (the|der|die|le|les|el|los) ', ' ', 'g') FROM documents
"""
ORACLES["length_change"] = f"""
SELECT pair_id, 100.0::DOUBLE * (length(after) - length(before)) / greatest(length(before), 1)
       AS length_change_pct FROM ({PAIRS})
"""
ORACLES["touched"] = f"""
WITH p AS ({PAIRS}),
a AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest({words('before')}) AS w FROM p)
      GROUP BY 1, 2),
b AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest({words('after')}) AS w FROM p)
      GROUP BY 1, 2),
c AS (SELECT a.pair_id, sum(least(a.n, b.n)) AS same FROM a JOIN b USING (pair_id, w) GROUP BY 1)
SELECT p.pair_id, round(CASE WHEN greatest({wc('before')}, {wc('after')}) > 0 THEN 100.0::DOUBLE * (1.0::DOUBLE -
         CAST(coalesce(c.same, 0) AS DOUBLE) / greatest({wc('before')}, {wc('after')}))
         ELSE 0 END, 6) AS touched_pct
FROM p LEFT JOIN c USING (pair_id)
"""
ORACLES["norm_caveats"] = """
SELECT CASE lang WHEN 'en' THEN 'main' ELSE 'side' END AS game,
       CASE lang WHEN 'en' THEN NULL ELSE 'нормы предварительные: borrowed from main. Оценки ритма '
       || 'и живого — ориентир, а не эталон, пока не набран корпус текстов в этой игре' END
       AS caveat, count(*) AS documents
FROM documents GROUP BY 1, 2
"""
HINT_SCORES = f"""
SELECT doc_id, text, {wc('text')} AS words,
       len(list_filter(toks, lambda x: x IN ('the', 'and'))) AS en,
       len(list_filter(toks, lambda x: x IN ('der', 'und'))) AS de,
       len(list_filter(toks, lambda x: x IN ('les', 'des', 'une'))) AS fr,
       len(regexp_extract_all(text, '!!')) + len(list_filter(toks,
         lambda x: x IN ('license', 'licence', 'licensed', 'licenced', 'licensd', 'licencd',
                         'licens', 'licenc'))) AS br
FROM (SELECT doc_id, text, list_transform({tokens('text')}, lambda x: lower(x)) AS toks FROM hd)
"""
PROFILED = """
SELECT *, CASE WHEN en + de + fr + br = 0 THEN 'brief' WHEN en >= greatest(de, fr, br) THEN 'en-report'
       WHEN de >= greatest(fr, br) THEN 'de-report' WHEN fr >= br THEN 'fr-report' ELSE 'brief' END
       AS profile,
       CASE WHEN en + de + fr + br = 0 THEN 0.0::DOUBLE
       ELSE %s END AS confidence
FROM sc
"""
MIN_WORDS = "CASE profile WHEN 'brief' THEN 80 WHEN 'fr-report' THEN 200 ELSE 300 END"
PROFILED = PROFILED % even("greatest(en, de, fr, br) / (en + de + fr + br)", 2)
ORACLES["short_documents"] = f"""
WITH hd AS ({HEADED}), sc AS ({HINT_SCORES}), pr AS ({PROFILED})
SELECT doc_id, words || ' of ' || {MIN_WORDS} || ' words' AS note FROM pr
WHERE words < {MIN_WORDS}
"""
ORACLES["evidence"] = "SELECT doc_id, substr(text, 1, 90) AS evidence FROM documents"

# -------------------------------------------------------------- detectors

TOKEN_APOS = r"[\p{L}\p{N}]+(?:[''’ʼ`\-–—−][\p{L}\p{N}]+)*"
ORACLES["name_apostrophes"] = f"""
WITH n AS (SELECT DISTINCT p_name, p_name[1:2] || '''' || p_name[3:] AS official FROM part),
d AS (SELECT doc_id, text || coalesce(chr(10) || 'A ' || p_name || ', a ' || p_name[1:2] || '’' || p_name[3:]
        || ' and a ' || p_name[1:2] || '''' || p_name[3:] || '. One ' || p_name || ' more.', '') AS text
      FROM documents LEFT JOIN part ON doc_id = p_partkey),
official_words AS (SELECT DISTINCT lower(unnest(string_split(official, ' '))) AS word FROM n),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_APOS}')) AS was FROM d),
k AS (SELECT DISTINCT split_part(official, ' ', 1) AS official FROM n)
SELECT doc_id, was, official, count(*) AS n
FROM w JOIN k ON replace(k.official, '''', '') = lower(regexp_replace(was, '[''’ʼ`]', '', 'g'))
WHERE lower(was) NOT IN (SELECT word FROM official_words) GROUP BY 1, 2, 3
"""
ORACLES["name_twins"] = f"""
WITH p AS (SELECT *, p_name[1:2] || '''' || p_name[3:] AS two, p_name[1:3] || '''' || p_name[4:] AS three,
             p_name[1:1] || '''' || p_name[2:] AS one FROM part),
n AS (SELECT two AS official FROM p UNION SELECT three FROM p UNION SELECT p_name FROM p WHERE p_partkey % 2 = 0),
w AS (SELECT DISTINCT unnest(string_split(official, ' ')) AS word FROM n),
k AS (SELECT word AS official FROM w WHERE contains(word, '''')),
d AS (SELECT doc_id, text || coalesce(chr(10) || 'A ' || two || ' and a ' || three || ' or ' || one || ' or ' || p_name || '.', '') AS text
      FROM documents LEFT JOIN p ON doc_id = p_partkey),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_APOS}')) AS was FROM d)
SELECT doc_id, was, official, count(*) AS n
FROM t JOIN k ON replace(k.official, '''', '') = lower(regexp_replace(was, '[''’ʼ`]', '', 'g'))
WHERE lower(was) NOT IN (SELECT word FROM w) GROUP BY 1, 2, 3
"""
def name_words(text: str) -> str:
    """Words of a text with punctuation marks as words of their own."""
    return (
        rf"list_filter(regexp_split_to_array(regexp_replace(regexp_replace({text}, '[.!?…]+', ' . ', 'g'), "
        r"'[^\p{L}\p{N}\s.''’ʼ`\-–—−]+', ' , ', 'g'), '\s+'), lambda x: x <> '')"
    )


# every three words in a row without a mark between them, of the texts in d
TRIPLES = f"""
p AS (SELECT doc_id, {name_words('text')} AS ws FROM d),
q AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS was
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM p)
      WHERE ws[i] NOT IN ('.', ',') AND ws[i + 1] NOT IN ('.', ',') AND ws[i + 2] NOT IN ('.', ','))
"""
ORACLES["name_dashes"] = f"""
WITH d AS (SELECT doc_id, text || coalesce(chr(10) || 'Take ' || replace(p_name, ' ', ' - ') || ' or ' || replace(p_name, ' ', ' — ')
        || ' or ' || replace(p_name, ' ', ' – ') || '; not ' || p_name || '.', '') AS text
      FROM documents LEFT JOIN part ON doc_id = p_partkey),
nm AS (SELECT DISTINCT replace(p_name, ' ', ' – ') AS official FROM part), {TRIPLES}
SELECT doc_id, was, official, count(*) AS n
FROM q JOIN nm ON lower(regexp_replace(official, '[-–—−]', '-', 'g')) = lower(regexp_replace(was, '[-–—−]', '-', 'g'))
WHERE lower(was) NOT IN (SELECT lower(official) FROM nm) GROUP BY 1, 2, 3
"""
ORACLES["name_case"] = f"""
WITH o AS (SELECT p_partkey, p_name || ' k' || p_partkey AS name, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' '
        || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' K' || p_partkey AS official FROM part),
d AS (SELECT doc_id, text || coalesce(chr(10) || 'We use ' || name || ' here. ' || upper(name[1]) || name[2:] || ' opens. '
        || official || ' is right, ' || upper(name) || ' is loud.', '') AS text
      FROM documents LEFT JOIN o ON doc_id = p_partkey), {TRIPLES}
SELECT doc_id, was, official, count(*) AS n
FROM q JOIN (SELECT DISTINCT official FROM o) ON lower(official) = lower(was) AND official <> was GROUP BY 1, 2, 3
"""
ORACLES["name_typos"] = f"""
WITH d AS (SELECT doc_id, text || coalesce(chr(10) || 'Use '
        || regexp_replace(p_name, '([a-z]{{4}})([a-z])', '\\1x\\2', 'g') || ' or z' || p_name[2:] || '.', '') AS text
      FROM documents LEFT JOIN part ON doc_id = p_partkey),
vv AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
t AS (SELECT doc_id, was, count(*) AS n FROM (
        SELECT doc_id, unnest({tokens('text')}) AS was FROM d) GROUP BY 1, 2),
low AS (SELECT DISTINCT lower(was) AS low, regexp_replace(lower(was), '[^a-z0-9]', '?', 'g') AS plain FROM t),
near AS (SELECT low, word, levenshtein(plain, word) AS edits FROM low JOIN vv
           ON abs(length(plain) - length(word)) <= 2
         WHERE levenshtein(plain, word) BETWEEN 1 AND least(2, greatest(length(plain), length(word)) // 4)
           AND regexp_replace(low, '(es|en|er|s|e)$', '') NOT IN
               (SELECT regexp_replace(word, '(es|en|er|s|e)$', '') FROM vv)),
m AS (SELECT low, arg_min(word, (edits, word)) AS official, CAST(min(edits) AS BIGINT) AS edits FROM near GROUP BY 1)
SELECT doc_id, was, n, official, edits FROM t JOIN m ON m.low = lower(was)
"""
COMMON = f"""
SELECT lemma, count(DISTINCT doc_id) AS documents FROM (
  SELECT doc_id, regexp_replace(lower(unnest({tokens('text')})), '(es|en|er|s|e)$', '') AS lemma
  FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) >= (SELECT count(*) FROM documents) * 0.05
"""
ORACLES["common_words"] = COMMON
ORACLES["short_names"] = f"""
WITH c AS ({COMMON}),
n AS (SELECT p_name || ' k' || p_partkey AS official FROM part),
o AS (SELECT regexp_replace(lower(w), '(es|en|er|s|e)$', '') AS lemma, min(official) AS official
      FROM (SELECT official, unnest(string_split(official, ' ')) AS w FROM n)
      GROUP BY 1 HAVING count(DISTINCT official) = 1),
d AS (SELECT doc_id, text || coalesce(chr(10) || 'The k' || p_partkey || ' and ' || p_name, '') AS text
      FROM documents LEFT JOIN part ON doc_id = p_partkey),
t AS (SELECT doc_id, unnest({tokens('text')}) AS was FROM d)
SELECT doc_id, was, official, count(*) AS n
FROM t JOIN o ON o.lemma = regexp_replace(lower(was), '(es|en|er|s|e)$', '')
WHERE o.lemma NOT IN (SELECT lemma FROM c) GROUP BY 1, 2, 3
"""
# prose words: headings and quotations blanked, sentence openings removed
OPENING = r"(^|[.!?…]\s+)[^\p{L}\p{N}.!?…]*[\p{L}\p{N}][\p{L}\p{N}\-''’ʼ]*"
PROSE_TAIL = f"""
t AS (SELECT ln.doc_id, string_agg(CASE WHEN h.line IS NULL THEN ln.line
              ELSE repeat(' ', length(ln.line)) END, {NL} ORDER BY ln.line_no) AS text
      FROM ln LEFT JOIN h ON h.doc_id = ln.doc_id AND h.line = ln.line_no GROUP BY 1),
p AS (SELECT doc_id, unnest(a) AS piece, unnest(range(1, len(a) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, '"[^"\\n]*"|[^"]+|"') AS a FROM t)),
m AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(piece, '^"[^"\\n]*"$')
        THEN repeat(' ', length(piece)) ELSE piece END, '' ORDER BY k) AS text FROM p GROUP BY 1)
"""
PROSE = f"ln AS ({LINES}), h AS ({HEADS}), {PROSE_TAIL}"


# Two-word names of prose (CTE m) that differ in capitals, as (doc_id, key, form, n).
CASE_FORMS = """
cw AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(
        regexp_replace(text, '%s', '\\1,', 'g'), '[.!?…]+', ' . ', 'g'),
        '[^\\p{L}\\p{N}\\s.\'\'’ʼ`\\-–—−]+', ' , ', 'g')), '\\s+'), lambda x: x <> '') AS a FROM m),
cb AS (SELECT doc_id, unnest(a) AS x, unnest(list_concat(a[2:], [NULL])) AS y FROM cw),
cf AS (SELECT doc_id, regexp_replace(lower(x), '(es|en|er|s|e)$', '') || ' '
               || regexp_replace(lower(y), '(es|en|er|s|e)$', '') AS key,
             regexp_replace(x, '(es|en|er|s|e)$', '') || ' '
               || regexp_replace(y, '(es|en|er|s|e)$', '') AS form, count(*) AS n
      FROM cb WHERE regexp_matches(x, '^\\p{Lu}\\p{Ll}') AND regexp_matches(y, '^\\p{L}\\p{Ll}')
      GROUP BY 1, 2, 3)
""" % OPENING


def _variants(strict: bool) -> str:
    return f"""
WITH hd AS (SELECT doc_id, regexp_replace(text, '([a-z]{{3}})(tion|ing|ment) (of|the|la|de) ',
              '\\1-\\2 \\3 ', 'g') AS text FROM documents), {PROSE},
w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{OPENING}', '\\1', 'g'),
        '[\\p{{L}}\\p{{N}}]+(?:[''’ʼ\\-][\\p{{L}}\\p{{N}}]+)*')) AS w FROM m),
hf AS (SELECT doc_id, regexp_replace(lower(replace(w, '-', '')), '(es|en|er|s|e)$', '') AS key,
             regexp_replace(lower(w), '(es|en|er|s|e)$', '') AS form, count(*) AS n
      FROM w GROUP BY 1, 2, 3),
{CASE_FORMS},
f AS (SELECT 'hyphen' AS kind, * FROM hf UNION ALL SELECT 'case', * FROM cf),
g AS (SELECT *, row_number() OVER (PARTITION BY kind, doc_id, key ORDER BY n DESC, form) AS r,
             max(n) OVER (PARTITION BY kind, doc_id, key) AS top,
             count(*) OVER (PARTITION BY kind, doc_id, key) AS forms FROM f)
SELECT doc_id, 'mixed spelling: ' || key AS message,
       string_agg(form || ' ×' || n, ', ' ORDER BY r) FILTER (WHERE r <= 4) AS evidence
       {"" if strict else ", 'likely' AS severity, CAST(0.85 AS DOUBLE) AS confidence"}
FROM g WHERE forms > 1 AND top >= {1 if strict else 2} GROUP BY kind, doc_id, key
"""


ORACLES["spelling_variants"] = _variants(False)
ORACLES["spelling_variants_strict"] = _variants(True)
ORACLES["case_variants"] = f"""
WITH hd AS (SELECT doc_id, text || chr(10) || 'See ' || i || ' and ' || i || ' or '
              || upper(p_name[1]) || p_name[2:] || ' now.' AS text
     FROM (SELECT *, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' '
             || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS i
           FROM part) JOIN documents ON doc_id = p_partkey), {PROSE},
w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(
        regexp_replace(text, '{OPENING}', '\\1,', 'g'), '[.!?…]+', ' . ', 'g'),
        '[^\\p{{L}}\\p{{N}}\\s.''’ʼ`\\-–—−]+', ' , ', 'g')), '\\s+'), lambda x: x <> '') AS a FROM m),
b AS (SELECT doc_id, unnest(a) AS x, unnest(list_concat(a[2:], [NULL])) AS y FROM w),
f AS (SELECT doc_id, regexp_replace(lower(x), '(es|en|er|s|e)$', '') || ' '
               || regexp_replace(lower(y), '(es|en|er|s|e)$', '') AS key,
             regexp_replace(x, '(es|en|er|s|e)$', '') || ' '
               || regexp_replace(y, '(es|en|er|s|e)$', '') AS form, count(*) AS n
      FROM b WHERE regexp_matches(x, '^\\p{{Lu}}\\p{{Ll}}') AND regexp_matches(y, '^\\p{{L}}\\p{{Ll}}')
      GROUP BY 1, 2, 3)
SELECT doc_id, key, string_agg(form || '=' || n, ';' ORDER BY n DESC, form) AS forms
FROM f GROUP BY 1, 2 HAVING count(*) > 1
"""
ORACLES["advice_conflicts"] = f"""
WITH d AS (SELECT doc_id, text || coalesce(chr(10) || '. Keep the ' || p_name || ', but drop ' || reverse(p_name) || '. Drop it all. '
        || CASE WHEN length(p_name) > 9 THEN 'Later drop ' ELSE 'Later keep ' END || p_name || '.', '') AS text
      FROM documents LEFT JOIN part ON doc_id = p_partkey),
s AS ({unnested('d', sents('text'), 'sentence', 'sentence_no')}),
c AS (SELECT doc_id, sentence_no, list_filter(list_transform(string_split(
        regexp_replace(sentence, '(?i)[,;]?\\s+(but|aber|pero|mais)\\s+', chr(1), 'g'), chr(1)),
        lambda x: trim(x)), lambda x: x <> '') AS a FROM s WHERE regexp_matches(sentence, '(?i)\\b(keep|drop)\\b')),
g AS (SELECT doc_id, sentence_no, unnest(a) AS segment, unnest(range(1, len(a) + 1)) AS segment_no FROM c),
p AS (SELECT *, regexp_matches(segment, '(?i)\\bkeep\\b') AS keep, regexp_matches(segment, '(?i)\\bdrop\\b') AS dropped,
        list_transform({name_words('segment')}, lambda w: regexp_replace(lower(w), '(es|en|er|s|e)$', '')) AS ws FROM g),
q AS (SELECT DISTINCT doc_id, sentence_no, segment_no, segment, keep, dropped, ws[i] || ' ' || ws[i + 1] AS key
      FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM p WHERE keep OR dropped)),
nm AS (SELECT DISTINCT p_name AS official, array_to_string(list_transform(string_split(p_name, ' '),
        lambda w: regexp_replace(w, '(es|en|er|s|e)$', '')), ' ') AS key FROM part)
SELECT doc_id, official, bool_or(keep) AS kept, bool_or(dropped) AS discarded,
       arg_min(segment, (sentence_no, segment_no)) FILTER (WHERE keep) AS keep_clause
FROM q JOIN nm USING (key) GROUP BY 1, 2
"""
ORACLES["declared_counts"] = f"""
WITH d AS (SELECT doc_id, 'Now 5 items:' || {NL} || '- ' || replace(text, {NL}, {NL} || '- ') || {NL} || 'Also 2 items:' || {NL}
        || '1. one' || {NL} || '2) two' || {NL} || 'end' AS text FROM documents),
ln AS ({unnested('d', f"string_split(text, {NL})", 'line', 'no')}),
k AS (SELECT *, regexp_matches(line, '^\\s*([-*•–]|\\d+[.)])\\s+') AS item FROM ln),
r AS (SELECT *, sum(CAST(NOT item AS INT)) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM k),
n AS (SELECT doc_id, run, min(no) AS no, count(*) FILTER (WHERE item) AS listed,
        max(CASE WHEN item THEN NULL ELSE regexp_extract(line, '(\\d+) items', 1) END) AS announced FROM r GROUP BY 1, 2)
SELECT doc_id, 'review' AS severity, 'заявлено карт: ' || CAST(announced AS BIGINT) || ', перечислено: ' || listed AS message, no AS line FROM n
WHERE announced <> '' AND listed > 0 AND CAST(announced AS BIGINT) <> listed
"""
ORACLES["profiles_detected"] = f"""
WITH hd AS ({HEADED}), sc AS ({HINT_SCORES}), pr AS ({PROFILED})
SELECT doc_id, profile, confidence FROM pr
"""
PROFILE_FACTS = """
SELECT * FROM (VALUES ('en-report', 300, true, 4), ('de-report', 300, true, 3),
  ('fr-report', 200, false, 2), ('brief', 80, false, 0)) f(profile, min_words, require_entities, sections)
"""
ORACLES["profiles_explicit"] = f"""
WITH hd AS (SELECT doc_id, text, lang FROM documents), sc AS ({HINT_SCORES}), pr AS ({PROFILED}),
f AS ({PROFILE_FACTS}),
c AS (SELECT pr.doc_id, CASE d.lang WHEN 'de' THEN 'brief' ELSE profile END AS profile,
        CASE d.lang WHEN 'de' THEN NULL ELSE confidence END AS profile_confidence
      FROM pr JOIN documents d USING (doc_id))
SELECT doc_id, profile, profile_confidence, CAST(min_words AS BIGINT) AS min_words,
       require_entities, CAST(sections AS BIGINT) AS sections
FROM c JOIN f USING (profile)
"""
STRUCTURED = f"""
hd AS ({HEADED}), sc AS ({HINT_SCORES}), pr AS ({PROFILED}), ln AS ({LINES}), h AS ({HEADS}),
s AS ({SECTIONS})
"""
KNOWN = """
k AS (SELECT pr.doc_id, h.line, s.idx, s.section_id,
             lead(h.line) OVER (PARTITION BY pr.doc_id ORDER BY h.line) AS next_line,
             lag(s.idx) OVER (PARTITION BY pr.doc_id ORDER BY h.line) AS before
      FROM pr JOIN h USING (doc_id) JOIN s ON s.profile = pr.profile AND s.variant = lower(h.title))
"""
MISSING = """
SELECT pr.doc_id, pr.profile, s.section_id, s.title, any_value(s.corpus_share) AS corpus_share,
       array_to_string(list(s.variant)[1:3], '; ') AS suggestion
FROM pr JOIN s USING (profile) LEFT JOIN h ON h.doc_id = pr.doc_id AND lower(h.title) = s.variant
WHERE s.required GROUP BY 1, 2, 3, 4 HAVING count(h.line) = 0
"""
FIRST_VARIANTS = """
CASE profile || '/' || section_id
 WHEN 'en-report/opening' THEN 'and ornd; of; hetible th'
 WHEN 'en-report/middle' THEN 'to to; thing'
 WHEN 'de-report/opening' THEN 'ietzte; stteen erachtz'
 WHEN 'de-report/middle' THEN 'enststung ench; und'
 WHEN 'fr-report/opening' THEN 'anquean çouê; le treque'
 WHEN 'fr-report/middle' THEN 'et; ench'
 ELSE 'all rights reserved; released under the mit license' END
"""
ORACLES["missing_sections"] = f"""
WITH {STRUCTURED}, x AS ({MISSING})
SELECT doc_id, 'structure.missing.' || section_id AS id, 'likely' AS severity,
       CAST(0.7 AS DOUBLE) AS confidence, 'no section ' || title AS message, '' AS evidence,
       {FIRST_VARIANTS} AS suggestion, CAST(coalesce(corpus_share, -1) AS BIGINT) AS corpus_share
FROM x
"""
ORACLES["section_order"] = f"""
WITH {STRUCTURED}, {KNOWN}
SELECT doc_id, 'structure.order.' || section_id AS id, 'review' AS severity, line
FROM k WHERE before > idx
"""
BODIES = """
b AS (SELECT k.doc_id, k.section_id, k.line,
             coalesce(string_agg(ln.line, chr(10) ORDER BY ln.line_no), '') AS body
      FROM k LEFT JOIN ln ON ln.doc_id = k.doc_id AND ln.line_no > k.line
           AND ln.line_no < coalesce(k.next_line, 1000000000)
      GROUP BY 1, 2, 3)
"""
ORACLES["section_bodies"] = f"""
WITH {STRUCTURED}, {KNOWN}, {BODIES}
SELECT doc_id, section_id, line, md5(body) AS body FROM b
"""
ENTITY_LIST = ["of", "of the", "de", "de la", "und"]
COVERAGE = f"""
o AS (SELECT b.doc_id, string_agg(body, chr(10) ORDER BY line) AS body FROM b JOIN pr USING (doc_id)
      WHERE section_id = 'opening' AND profile IN ('en-report', 'de-report') GROUP BY 1),
ct AS (SELECT doc_id, list_transform({tokens('body')}, lambda x: lower(x)) AS a FROM o),
e AS (SELECT doc_id, len(list_filter(range(1, len(a) + 1), lambda i: a[i] = 'of' AND a[i+1] = 'the')) AS of_the,
        len(list_filter(range(1, len(a) + 1), lambda i: a[i] = 'of' AND coalesce(a[i+1], '') <> 'the')) AS of_,
        len(list_filter(range(1, len(a) + 1), lambda i: a[i] = 'de' AND a[i+1] = 'la')) AS de_la,
        len(list_filter(range(1, len(a) + 1), lambda i: a[i] = 'de' AND coalesce(a[i+1], '') <> 'la')) AS de_,
        len(list_filter(a, lambda x: x = 'und')) AS und_ FROM ct),
c AS (SELECT doc_id, concat_ws(', ', CASE WHEN of_ = 0 THEN 'of' END,
        CASE WHEN of_the = 0 THEN 'of the' END, CASE WHEN de_ = 0 THEN 'de' END,
        CASE WHEN de_la = 0 THEN 'de la' END, CASE WHEN und_ = 0 THEN 'und' END) AS evidence FROM e)
"""
ORACLES["entity_coverage"] = f"""
WITH {STRUCTURED}, {KNOWN}, {BODIES}, {COVERAGE}
SELECT doc_id, 'structure.matchups' AS id, 'review' AS severity, evidence FROM c WHERE evidence <> ''
"""


def artifact_counts(source: str) -> str:
    return f"""
SELECT doc_id, 'licence line' AS label, len(regexp_extract_all(lower(text),
  'licensed under|all rights reserved|released under')) AS n FROM {source}
UNION ALL SELECT doc_id, 'hyphen break', len(regexp_extract_all(text,
  '\\p{{L}}-\\s*\\n\\s*\\p{{Ll}}')) FROM {source}
UNION ALL SELECT doc_id, 'phone', len(regexp_extract_all(text,
  '\\+1 \\([0-9]{{3}}\\) [0-9]{{3}}-[0-9]{{4}}')) FROM {source}
UNION ALL SELECT doc_id, 'markup noise', len(regexp_extract_all(text, '[*#%&$]{{3,}}')) FROM {source}
UNION ALL SELECT doc_id, 'table bar', len(list_filter(string_split(text, chr(10)),
  lambda x: contains(x, '|'))) FROM {source}
"""


ORACLES["extraction_artifacts"] = f"""
SELECT doc_id, label, 'review' AS severity, CAST(n AS BIGINT) AS n
FROM ({artifact_counts('documents')}) WHERE n > 0
"""
ORACLES["page_artifacts"] = f"""
WITH d AS (SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages)
SELECT doc_id, label, CAST(n AS BIGINT) AS n FROM ({artifact_counts('d')}) WHERE n > 0
"""
VOICE = f"""
SELECT *, len(list_filter(toks, lambda x: x IN ('the', 'der', 'die', 'das', 'le', 'les', 'el', 'los'))) AS address,
  len(list_filter(toks, lambda x: regexp_matches(x, '^.{{2,}}(tion|ment|lich|ing)$') AND x <> 'thing')) AS imperative,
  len(list_filter(ss, lambda x: regexp_matches(x, '^(And|Und|Et|De)($|[^\\p{{L}}\\p{{N}}_])')))
    + len(list_filter(toks, lambda x: x IN ('by', 'mit', 'pour', 'por'))) AS concession,
  len(list_filter(lens, lambda n: n > 1 AND n < 8)) AS short_sentence,
  len(regexp_extract_all(text, '\\([^)]+\\)')) AS parenthesis
FROM (SELECT *, list_transform({tokens('text')}, lambda x: lower(x)) AS toks,
        list_transform(ss, lambda x: {wc('x')}) AS lens, {wc('text')} AS words
      FROM (SELECT *, {sents('text')} AS ss FROM src))
"""
ORACLES["conversation_voice"] = f"""
WITH src AS (SELECT role, text FROM conversations), v AS ({VOICE})
SELECT role, count(*) AS turns, CAST(sum(words) AS BIGINT) AS words,
  CAST(sum(CASE WHEN words > 0 THEN address END) AS BIGINT) AS address,
  CAST(sum(CASE WHEN words > 0 THEN imperative END) AS BIGINT) AS imperative,
  CAST(sum(CASE WHEN words > 0 THEN concession END) AS BIGINT) AS concession,
  CAST(sum(CASE WHEN words > 0 THEN short_sentence END) AS BIGINT) AS short_sentence,
  CAST(sum(CASE WHEN words > 0 THEN parenthesis END) AS BIGINT) AS parenthesis
FROM v GROUP BY role
"""
TERMS = [
    ("term.the", "auto_replace", "slang", "thing", "that"),
    ("term.ring", "auto_replace", "slang", "anthe", "thering"),
    ("term.andnd", "auto_replace", "slang", "that", "thing"),
    ("term.mentre", "allowed", "slang", "queque", ""),
    ("term.lich", "allowed", "slang", "lichen", ""),
    ("term.for", "forbidden", "slang", "eauouon", ""),
    ("term.word", "allowed", "word", "ciónado", ""),
]
RIVALS = [
    ("term.the", "preferred", "that"),
    ("term.ring", "preferred", "thering"),
    ("term.andnd", "preferred", "thing"),
    ("term.mentre", "rejected", "mentai"),
    ("term.lich", "alternative", "lichung"),
    ("term.for", "preferred", "ouonle"),
]


def stem_of(word: str) -> str:
    return word[:-1] if len(word) > 4 else word


ORACLES["term_hits"] = f"""
WITH dl AS ({DOC_LINES}), w AS (SELECT doc_id, line_no, unnest({tokens('line')}) AS t FROM dl),
r AS (SELECT * FROM (VALUES {', '.join(
    f"('{i}', '{d}', '{stem_of(w)}', '{p}')" for i, d, _, w, p in TERMS)}) v(id, category, stem, fix))
SELECT doc_id, id, category, t AS evidence, fix AS suggestion, line_no AS line
FROM w JOIN r ON starts_with(lower(t), stem)
"""
ORACLES["typography_hits"] = """
SELECT doc_id, 'typography.accent' AS id, 'оформление: e-grave' AS message, 'è' AS evidence,
       CAST(len(regexp_extract_all(text, 'è')) AS BIGINT) AS n FROM documents WHERE contains(text, 'è')
UNION ALL
SELECT doc_id, 'typography.marks', 'оформление: double', '!!',
       CAST(len(regexp_extract_all(text, '!!')) AS BIGINT) FROM documents WHERE contains(text, '!!')
"""
VARIANT_COUNTS = f"""
SELECT r.id, r.role, r.word, count(w.t) AS n
FROM (VALUES {', '.join([f"('{i}', '{role}', '{w}', '{stem_of(w)}')" for i, _, role, w, _ in TERMS]
  + [f"('{i}', '{role}', '{w}', '{stem_of(w)}')" for i, role, w in RIVALS])}) r(id, role, word, stem)
LEFT JOIN (SELECT lower(unnest({tokens('text')})) AS t FROM documents) w ON starts_with(w.t, r.stem)
GROUP BY 1, 2, 3
"""
ORACLES["variant_counts"] = VARIANT_COUNTS
ORACLES["typography_counts"] = """
SELECT rule, variant, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'accent' AS rule, 'e-acute' AS variant, len(regexp_extract_all(text, 'é')) AS n FROM documents
  UNION ALL SELECT 'accent', 'e-grave', len(regexp_extract_all(text, 'è')) FROM documents
  UNION ALL SELECT 'range', 'hyphen', len(regexp_extract_all(text, '[0-9]+-[0-9]+')) FROM documents
  UNION ALL SELECT 'quotes', 'straight', len(regexp_extract_all(text, '"')) FROM documents
  UNION ALL SELECT 'percent', 'sign', len(regexp_extract_all(text, '[0-9]+%')) FROM documents
  UNION ALL SELECT 'marks', 'double', len(regexp_extract_all(text, '!!')) FROM documents
  UNION ALL SELECT 'marks', 'comma-space', len(regexp_extract_all(text, ', ')) FROM documents)
GROUP BY 1, 2
"""
ORACLES["rule_conflicts"] = f"""
WITH v AS ({VARIANT_COUNTS}),
s AS (SELECT id, max(n) FILTER (WHERE role IN ('slang', 'word')) AS a,
             max(n) FILTER (WHERE role = 'preferred') AS b FROM v GROUP BY 1)
SELECT 'replacement-rarer' AS problem, id AS subject, a || ' > ' || b AS detail
FROM s WHERE id IN ('term.the', 'term.ring', 'term.andnd') AND a > b
"""

# ------------------------------------------------------------ integrity

FILED = """
SELECT printf('doc-%09d.md', doc_id) AS path, doc_id, md5(text) AS id, n_chars,
  text,
  CASE source WHEN 'src0' THEN 'standard' WHEN 'src1' THEN 'wild' WHEN 'src2' THEN 'unknown'
    ELSE source END AS game_mode,
  CASE lang WHEN 'es' THEN 'essay' ELSE lang || '-report' END AS genre,
  CASE lang WHEN 'de' THEN 'washed' ELSE 'cleaned' END AS clean_status
FROM (SELECT doc_id, text, lang, source, n_chars FROM documents
      UNION ALL SELECT -1 - doc_id, '', lang, source, 0 FROM documents WHERE doc_id % 50 = 0)
"""
ORACLES["empty_documents"] = f"""
SELECT path, 'error' AS severity, 'файл без текста' AS message FROM ({FILED}) WHERE text = ''
"""
ORACLES["missing_fields"] = f"""
WITH f AS ({FILED})
SELECT path, 'likely' AS severity, 'нет поля updated_at' AS message FROM f
WHERE text <> '' AND n_chars <= 500
UNION ALL SELECT path, 'likely', 'нет поля patch' FROM f WHERE text <> '' AND n_chars <= 300
"""
ORACLES["duplicate_ids"] = f"""
SELECT path, id, previous FROM (
  SELECT path, id, lag(path) OVER (PARTITION BY id ORDER BY path) AS previous
  FROM ({FILED}) WHERE text <> '') WHERE previous IS NOT NULL
"""
ORACLES["unknown_genres"] = f"""
SELECT path, 'error' AS severity, 'жанр ''essay'' не соответствует ни одному профилю '
  || '(brief, de-report, en-report, fr-report)' AS message
FROM ({FILED}) WHERE text <> '' AND genre = 'essay'
"""
ORACLES["unknown_domains"] = f"""
WITH f AS ({FILED})
SELECT path, 'corpus.unknown-mode' AS id, 'likely' AS severity,
       'режим ''' || game_mode || ''' неизвестен' AS message
FROM f WHERE text <> '' AND game_mode LIKE 'src%'
UNION ALL SELECT path, 'corpus.unknown-status', 'likely', 'статус ''washed'' неизвестен'
FROM f WHERE text <> '' AND clean_status = 'washed'
"""
ORACLES["corpus_validation"] = f"""
WITH f AS ({FILED}),
d AS (SELECT doc_id, text FROM f WHERE text <> ''),
x AS (
  SELECT 'corpus.empty-file' AS id, 'error' AS severity, path FROM f WHERE text = ''
  UNION ALL SELECT 'corpus.missing-field', 'likely', path FROM f WHERE text <> '' AND n_chars <= 500
  UNION ALL SELECT 'corpus.missing-field', 'likely', path FROM f WHERE text <> '' AND n_chars <= 300
  UNION ALL SELECT 'corpus.duplicate-id', 'error', path FROM ({ORACLES["duplicate_ids"]})
  UNION ALL SELECT 'corpus.unknown-genre', 'error', path FROM f WHERE text <> '' AND genre = 'essay'
  UNION ALL SELECT id, severity, path FROM ({ORACLES["unknown_domains"]})
  UNION ALL SELECT 'corpus.extraction-artifact', 'review', CAST(doc_id AS VARCHAR)
    FROM ({artifact_counts('d')}) WHERE n > 0)
SELECT id, severity, count(*) AS findings, count(DISTINCT path) AS documents FROM x GROUP BY 1, 2
"""
ORACLES["corpus_stats"] = f"""
WITH f AS (SELECT *, {wc('text')} AS words, 1 + CAST(n_chars > 500 AS INT) + CAST(n_chars > 300 AS INT)
             + CAST(game_mode = 'unknown' AS INT) AS unknown FROM ({FILED}))
SELECT 'genre' AS level, genre AS value, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words,
       CAST(sum(unknown) AS BIGINT) AS unknown_values FROM f GROUP BY genre
UNION ALL SELECT 'mode', game_mode, count(*), CAST(sum(words) AS BIGINT), CAST(sum(unknown) AS BIGINT)
FROM f GROUP BY game_mode
UNION ALL SELECT 'all', '', count(*), CAST(sum(words) AS BIGINT), CAST(sum(unknown) AS BIGINT) FROM f
"""
ORACLES["corpus_split"] = f"""
WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM ({FILED}))
SELECT id, CASE WHEN bool_or(i % 5 = 0) THEN 'holdout' ELSE 'calibration' END AS part
FROM r GROUP BY id
"""
ORACLES["split_sizes"] = """
WITH r AS (SELECT source || '-' || lang AS id,
             row_number() OVER (ORDER BY source || '-' || lang) - 1 AS i FROM documents),
p AS (SELECT 0.0 AS share, id, 'calibration' AS part FROM r GROUP BY id
  UNION ALL SELECT 0.1, id, CASE WHEN bool_or(i % 10 = 0) THEN 'holdout' ELSE 'calibration' END FROM r GROUP BY id
  UNION ALL SELECT 0.5, id, CASE WHEN bool_or(i % 2 = 0) THEN 'holdout' ELSE 'calibration' END FROM r GROUP BY id)
SELECT part, count(*) AS ids, CAST(share AS DOUBLE) AS share FROM p GROUP BY part, share
"""

# ------------------------------------------------------------- measures


def dec(value: str, digits: int) -> str:
    """Round half up on the decimal form of a double."""
    return f"CAST(round(CAST({value} AS DECIMAL(38, 16)), {digits}) AS DOUBLE)"


MEASURED = f"""
SELECT *, CASE WHEN n >= 2 AND s > 0 THEN sqrt(CAST(n * q - s * s AS DOUBLE)) / s END AS ratio,
  CASE WHEN n >= 2 AND s > 0 THEN CAST(s AS DOUBLE) / n END AS mean,
  CASE WHEN words > 0 THEN address * 1000.0::DOUBLE / words + imperative * 1000.0::DOUBLE / words
    + concession * 1000.0::DOUBLE / words + short_sentence * 1000.0::DOUBLE / words
    + parenthesis * 1000.0::DOUBLE / words END AS per1k,
  address + imperative + concession + short_sentence + parenthesis AS voice_n
FROM (SELECT *, CAST(len(lens) AS BIGINT) AS n, CAST(coalesce(list_sum(lens), 0) AS BIGINT) AS s,
        CAST(coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0) AS BIGINT) AS q
      FROM ({VOICE}))
"""
DOCS_SRC = "src AS (SELECT doc_id, text, lang FROM documents)"
ORACLES["rhythm"] = f"""
WITH {DOCS_SRC}, v AS ({MEASURED})
SELECT doc_id, words, n AS sentence_count, coalesce(ratio, -1) AS ratio, coalesce(mean, -1) AS mean
FROM v
"""
ORACLES["voice"] = f"""
WITH {DOCS_SRC}, v AS ({MEASURED})
SELECT doc_id, address, imperative, concession, short_sentence, parenthesis, per1k AS voice_per_1k
FROM v
"""
ORACLES["marker_density"] = f"""
WITH dl AS ({DOC_LINES}), hits AS ({HITS}),
c AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1),
g AS (SELECT lang, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS hits, CAST(sum({wc('text')}) AS BIGINT) AS words
      FROM documents LEFT JOIN c USING (doc_id) GROUP BY 1)
SELECT lang, hits, words, hits * 10000.0::DOUBLE / words AS per_10k FROM g
"""
GAME = "CASE lang WHEN 'en' THEN 'main' ELSE 'side' END"
ORACLES["norm_comparison"] = f"""
WITH {DOCS_SRC}, v AS ({MEASURED})
SELECT {GAME} AS game, lang <> 'en' AS provisional, CAST(0.6 AS DOUBLE) AS norm_rhythm_ratio,
  CAST(150 AS DOUBLE) AS norm_voice_per_1k, count(*) AS documents,
  CAST(sum(CAST(ratio < 0.6::DOUBLE AS INT)) AS BIGINT) AS below_rhythm,
  CAST(sum(CAST(per1k < 150 AS INT)) AS BIGINT) AS below_voice
FROM v GROUP BY 1, 2
"""
ORACLES["alarms"] = f"""
WITH {DOCS_SRC}, v AS ({MEASURED})
SELECT doc_id, {GAME} AS game, coalesce(ratio < 0.45::DOUBLE, false) AS rhythm_alarm,
       coalesce(per1k < 100, false) AS voice_alarm
FROM v WHERE ratio < 0.45::DOUBLE OR per1k < 100
"""
LATIN_STEM = "'(es|en|er|s|e)$', ''"
VARIANT_GROUPS = f"""
vw AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{OPENING}', '\\1', 'g'),
        '[\\p{{L}}\\p{{N}}]+(?:[''’ʼ\\-][\\p{{L}}\\p{{N}}]+)*')) AS w FROM m),
vc AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(
        regexp_replace(text, '{OPENING}', '\\1,', 'g'), '[.!?…]+', ' . ', 'g'),
        '[^\\p{{L}}\\p{{N}}\\s.''’ʼ`\\-–—−]+', ' , ', 'g')), '\\s+'), lambda x: x <> '') AS a FROM m),
vb AS (SELECT doc_id, unnest(a) AS x, unnest(list_concat(a[2:], [NULL])) AS y FROM vc),
vf AS (SELECT doc_id, regexp_replace(lower(replace(w, '-', '')), {LATIN_STEM}) AS key,
         regexp_replace(lower(w), {LATIN_STEM}) AS form FROM vw
       UNION ALL
       SELECT doc_id, regexp_replace(lower(x), {LATIN_STEM}) || ' ' || regexp_replace(lower(y), {LATIN_STEM}),
         regexp_replace(x, {LATIN_STEM}) || ' ' || regexp_replace(y, {LATIN_STEM})
       FROM vb WHERE regexp_matches(x, '^\\p{{Lu}}\\p{{Ll}}') AND regexp_matches(y, '^\\p{{L}}\\p{{Ll}}')),
vg AS (SELECT doc_id, key FROM (SELECT doc_id, key, form, count(*) AS n FROM vf GROUP BY 1, 2, 3)
       GROUP BY 1, 2 HAVING count(*) > 1 AND max(n) >= 2)
"""
WEIGHTS = "CASE profile WHEN 'brief' THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END"
STRUCT_WEIGHT = "CASE profile WHEN 'brief' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END"


def clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(10.0::DOUBLE, greatest(0.0::DOUBLE, {x})) END"


SCORED = f"""
{STRUCTURED}, {KNOWN}, {BODIES}, {COVERAGE.strip().rsplit("c AS (", 1)[0].rstrip().rstrip(",")},
{PROSE_TAIL}, {VARIANT_GROUPS},
dl AS (SELECT * FROM ln), hits AS ({HITS}), src AS (SELECT doc_id, text FROM hd), v AS ({MEASURED}),
req AS (SELECT pr.doc_id, count(DISTINCT s.section_id) AS required,
          count(DISTINCT s.section_id) FILTER (WHERE h.line IS NOT NULL) AS found
        FROM pr JOIN s USING (profile)
        LEFT JOIN h ON h.doc_id = pr.doc_id AND lower(h.title) = s.variant WHERE s.required GROUP BY 1),
inp AS (SELECT pr.doc_id, pr.profile, v.words, v.per1k, v.ratio, v.voice_n,
    coalesce(req.required, 0) AS required, coalesce(req.found, 0) AS found,
    CASE WHEN pr.profile IN ('en-report', 'de-report') THEN 5 ELSE 0 END AS entity_total,
    coalesce(CAST(of_ > 0 AS INT) + CAST(of_the > 0 AS INT) + CAST(de_ > 0 AS INT)
      + CAST(de_la > 0 AS INT) + CAST(und_ > 0 AS INT), 0) AS entities,
    coalesce(hh.n, 0) AS markers, coalesce(vv.n, 0) AS variants
  FROM pr JOIN v USING (doc_id) LEFT JOIN req USING (doc_id) LEFT JOIN e USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) hh USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM vg GROUP BY 1) vv USING (doc_id)),
parts AS (SELECT *, {clamp("10.0::DOUBLE * (per1k - 5.0::DOUBLE) / (150.0::DOUBLE - 5.0::DOUBLE)")} AS c_voice,
    {clamp("10.0::DOUBLE * (ratio - 0.2::DOUBLE) / (0.6::DOUBLE - 0.2::DOUBLE)")} AS c_rhythm,
    {clamp("10.0::DOUBLE - markers * 1000.0::DOUBLE / words")} AS c_purity,
    {clamp("10.0::DOUBLE - variants")} AS c_consistency,
    {clamp("10.0::DOUBLE * (0.7::DOUBLE * (CASE WHEN required > 0 THEN found::DOUBLE / required ELSE 1 END) + 0.3::DOUBLE * (CASE WHEN entity_total > 0 THEN entities::DOUBLE / entity_total ELSE 1 END))")} AS c_structure
  FROM inp),
scored AS (SELECT *, {WEIGHTS} * c_voice + {WEIGHTS} * c_rhythm + {STRUCT_WEIGHT} * c_structure AS score
  FROM parts)
"""
ORACLES["author_scores"] = f"""
WITH {SCORED}
SELECT doc_id, profile, round(coalesce(c_voice, -1), 6) AS voice, round(coalesce(c_rhythm, -1), 6) AS rhythm,
  round(coalesce(c_purity, -1), 6) AS purity, round(coalesce(c_consistency, -1), 6) AS consistency,
  round(coalesce(c_structure, -1), 6) AS structure, round(coalesce(score, -1), 6) AS score
FROM scored
"""
ORACLES["score_calibration"] = f"""
WITH {SCORED}
SELECT profile, count(*) AS n, round(min(score), 6) AS minimum, round(quantile_cont(score, 0.25), 6) AS p25,
       round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75
FROM scored WHERE score IS NOT NULL GROUP BY 1
"""
ORACLES["corpus_regression"] = f"""
WITH {SCORED}, g AS (
  SELECT CAST(sum(markers) AS BIGINT) * 10000.0::DOUBLE / CAST(sum(words) AS BIGINT) AS a,
    CAST(sum(voice_n) AS BIGINT) * 1000.0::DOUBLE / CAST(sum(words) AS BIGINT) AS b,
    CAST(sum(CAST(found * 2 >= required AS INT)) AS BIGINT) * 100.0::DOUBLE / count(*) AS c,
    CAST(sum(variants) AS DOUBLE) / count(*) AS d FROM inp)
SELECT 'markers_per_10k' AS "check", a AS value, 20.0::DOUBLE AS threshold, a <= 20 AS ok FROM g
UNION ALL SELECT 'voice_per_1k', b, 20.0::DOUBLE, b >= 20 FROM g
UNION ALL SELECT 'structure_pct', c, 90.0::DOUBLE, c >= 90 FROM g
UNION ALL SELECT 'variants_per_doc', d, 1.0::DOUBLE, d <= 1 FROM g
"""
ORACLES["tighten_hints"] = f"""
WITH s AS ({unnested('documents', sents('text'), 'sentence', 'no')}),
l AS (SELECT doc_id, sentence, no, {wc('sentence')} AS w FROM s),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, no) = 1),
dl AS ({DOC_LINES}),
t AS (SELECT doc_id, line_no, tok, k FROM (
  SELECT doc_id, line_no, unnest(a) AS tok, unnest(range(1, len(a) + 1)) AS k
  FROM (SELECT doc_id, line_no, {tokens('line')} AS a FROM dl))
  WHERE lower(tok) IN ('is', 'are', 'est', 'es')),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) = 1),
c AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1)
SELECT doc_id, b.w AS longest_words, b.no AS longest_sentence_no, coalesce(c.n, 0) AS impersonal_count,
  md5(b.sentence) AS longest_sentence, coalesce(f.line_no, -1) AS impersonal_line,
  coalesce(f.tok, '') AS impersonal_phrase
FROM b LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES["section_hints"] = f"""
WITH {STRUCTURED}, ms AS ({MISSING}),
o AS (SELECT DISTINCT profile, section_id, idx FROM s)
SELECT pr.doc_id, coalesce(arg_min(ms.title, o.idx), '') AS missing_section
FROM pr LEFT JOIN ms ON ms.doc_id = pr.doc_id
LEFT JOIN o ON o.profile = ms.profile AND o.section_id = ms.section_id GROUP BY 1
"""
ORACLES["name_scores"] = f"""
WITH e AS (SELECT doc_id, sum(n) AS n FROM ({ORACLES["name_apostrophes"]}) GROUP BY 1)
SELECT doc_id, CAST(greatest(0, 10 - coalesce(e.n, 0)) AS DOUBLE) AS score_names
FROM documents LEFT JOIN e USING (doc_id)
"""

# ---------------------------------------------------------- aggregations

SMALL_AUDIT = f"""
{STRUCTURED}, dl AS (SELECT * FROM ln), hits AS ({HITS}), ms AS ({MISSING}),
fx AS (
  SELECT doc_id, 'markers.' || id AS id, CASE action WHEN 'review' THEN 'review' ELSE 'likely' END
    AS severity, line_no AS line FROM hits
  UNION ALL SELECT doc_id, 'corpus.extraction-artifact', 'review', 0
    FROM ({artifact_counts('hd')}) WHERE n > 0
  UNION ALL SELECT doc_id, 'structure.missing.' || section_id, 'likely', 0 FROM ms),
cx AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'likely') AS likely,
         count(*) FILTER (WHERE severity = 'review') AS review FROM fx GROUP BY 1)
"""
ORACLES["severity_summary"] = f"""
WITH {SMALL_AUDIT}
SELECT doc_id, CAST(0 AS BIGINT) AS error, coalesce(likely, 0) AS likely, coalesce(review, 0) AS review,
       CAST(0 AS BIGINT) AS info
FROM documents LEFT JOIN cx USING (doc_id)
"""
ORACLES["worst_severity"] = f"""
WITH {SMALL_AUDIT}
SELECT doc_id, CASE WHEN likely > 0 THEN 'likely' WHEN review > 0 THEN 'review' ELSE '' END AS worst
FROM documents LEFT JOIN cx USING (doc_id)
"""
ORACLES["quality_gate"] = f"""
WITH {SMALL_AUDIT}, d AS (SELECT doc_id, coalesce(likely, 0) AS likely, coalesce(review, 0) AS review
  FROM documents LEFT JOIN cx USING (doc_id))
SELECT 'error' AS fail_on, doc_id, CAST(0 AS BIGINT) AS exit_code FROM d
UNION ALL SELECT 'likely', doc_id, CAST(likely > 0 AS BIGINT) FROM d
UNION ALL SELECT 'review', doc_id, CAST(likely + review > 0 AS BIGINT) FROM d
"""
ORACLES["observed_gate"] = f"""
WITH {SMALL_AUDIT},
c AS (SELECT 0 AS rank, 'error' AS severity, CAST(0 AS BIGINT) AS findings
  UNION ALL SELECT 1, 'likely', CAST(coalesce(sum(likely), 0) AS BIGINT) FROM cx
  UNION ALL SELECT 2, 'review', CAST(coalesce(sum(review), 0) AS BIGINT) FROM cx
  UNION ALL SELECT 3, 'info', CAST(0 AS BIGINT))
SELECT severity, findings, CAST((SELECT sum(findings) FROM c x WHERE x.rank <= c.rank) > 0 AS BIGINT) AS exit_code FROM c
"""
ORACLES["ordered_findings"] = f"""
WITH {SMALL_AUDIT}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY
         CASE severity WHEN 'likely' THEN 1 ELSE 2 END, line, id) AS position, severity, id,
       CAST(line AS BIGINT) AS line FROM fx
"""
ORACLES["archive_audit"] = f"""
WITH a AS (SELECT 'name_apostrophes' AS kind, was, official, n, false AS art
             FROM ({ORACLES['name_apostrophes']})
  UNION ALL SELECT 'name_dashes', was, official, n, false FROM ({ORACLES['name_dashes']})
  UNION ALL SELECT 'name_case', was, official, n, regexp_matches(was, '^[A-Z ]+$')
    FROM ({ORACLES['name_case']})),
p AS (SELECT kind, art, was, official, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1, 2, 3, 4)
SELECT kind, art AS from_artifact, was, official, n, CAST(-1 AS BIGINT) AS pairs FROM p
UNION ALL SELECT kind, false, '*', '*', CAST(sum(n) AS BIGINT), count(*) FROM p WHERE NOT art GROUP BY 1
"""
ORACLES["fitted_norms"] = f"""
WITH {DOCS_SRC}, v AS ({MEASURED}),
r AS (SELECT doc_id, md5(text) AS id, row_number() OVER (ORDER BY md5(text)) - 1 AS i FROM documents),
sp AS (SELECT id, CASE WHEN bool_or(i % 5 = 0) THEN 'holdout' ELSE 'calibration' END AS part
       FROM r GROUP BY id),
x AS (SELECT part, unnest(['address', 'imperative', 'concession', 'short_sentence', 'parenthesis',
          'voice_per_1k', 'rhythm_ratio', 'sentence_mean']) AS measure,
        unnest([address * 1000.0::DOUBLE / words, imperative * 1000.0::DOUBLE / words,
          concession * 1000.0::DOUBLE / words, short_sentence * 1000.0::DOUBLE / words,
          parenthesis * 1000.0::DOUBLE / words, per1k, ratio, mean]) AS value
      FROM v JOIN r USING (doc_id) JOIN sp USING (id)),
y AS (SELECT part, measure, value FROM x WHERE value IS NOT NULL)
SELECT part, measure, count(*) AS n, round(min(value), 6) AS minimum,
       round(quantile_cont(value, 0.5), 6) AS p50 FROM y GROUP BY 1, 2
"""
ORACLES["labelled_measures"] = f"""
WITH {DOCS_SRC}, v AS ({MEASURED})
SELECT quality, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words,
       CAST(sum(voice_n) AS BIGINT) AS voice_n
FROM v JOIN labels USING (doc_id) GROUP BY 1
"""
ORACLES["section_share"] = f"""
WITH {STRUCTURED},
x AS (SELECT pr.doc_id, pr.profile, s.section_id, count(h.line) > 0 AS present
      FROM pr JOIN s USING (profile)
      LEFT JOIN h ON h.doc_id = pr.doc_id AND lower(h.title) = s.variant GROUP BY 1, 2, 3)
SELECT profile, section_id, count(*) AS documents, CAST(sum(CAST(present AS INT)) AS BIGINT) AS present,
       sum(CAST(present AS INT)) * 100.0::DOUBLE / count(*) AS share_pct FROM x GROUP BY 1, 2
"""
ORACLES["heading_variant_share"] = f"""
WITH {STRUCTURED}
SELECT pr.profile, s.section_id, s.variant, count(DISTINCT pr.doc_id) AS documents
FROM pr JOIN h USING (doc_id) JOIN s ON s.profile = pr.profile AND s.variant = lower(h.title)
GROUP BY 1, 2, 3
"""
OCCURRENCES = f"""
s AS ({unnested('documents', sents('text'), 'sentence', 'no')}),
o AS (SELECT doc_id, no, sentence, lower(unnest(regexp_extract_all(sentence,
        '[\\p{{L}}\\p{{N}}\\-]+'))) AS word FROM s)
"""
ORACLES["precedent"] = f"""
WITH {OCCURRENCES},
q AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS word FROM benchmark),
c AS (SELECT word, count(*) AS n, count(DISTINCT doc_id || '/' || no) AS sents FROM o
      JOIN q USING (word) GROUP BY 1),
e AS (SELECT word, doc_id, sentence FROM o JOIN q USING (word)
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY doc_id, no) = 1)
SELECT word, coalesce(c.n, 0) AS occurrences, coalesce(c.sents, 0) AS sentences,
       coalesce(e.doc_id, -1) AS example_doc, coalesce(e.sentence, '') AS example,
       CASE WHEN c.n IS NULL THEN 'absent' ELSE '' END AS note
FROM q LEFT JOIN c USING (word) LEFT JOIN e USING (word)
"""
ORACLES["precedent_counts"] = f"""
WITH {OCCURRENCES},
q AS (SELECT DISTINCT word FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS word FROM part
      UNION ALL SELECT lang FROM documents)),
c AS (SELECT word, count(*) AS n FROM o JOIN q USING (word) GROUP BY 1)
SELECT word, coalesce(n, 0) AS occurrences, CASE WHEN n IS NULL THEN 'absent' ELSE '' END AS note
FROM q LEFT JOIN c USING (word)
"""


def echo_sql(drafts: str, keep: str) -> str:
    def posting(source: str) -> str:
        paragraphs = unnested(
            source,
            f"list_filter(string_split(text, {NL}), lambda x: regexp_matches(x, '\\S'))",
            "par",
            "no",
        )
        return (
            "SELECT DISTINCT doc_id, no, word FROM (SELECT doc_id, no, "
            f"regexp_replace(lower(unnest({tokens('par')})), {LATIN_STEM}) AS word "
            f"FROM ({paragraphs}))"
        )

    return f"""
WITH dr AS ({drafts}),
a AS ({posting('documents')}),
b AS ({posting('dr')}),
rare AS (SELECT word FROM a GROUP BY 1 HAVING count(*) <= 3)
SELECT b.doc_id AS draft_id, b.no AS draft_paragraph, a.no AS paragraph_no, a.doc_id,
       count(*) AS shared {keep}
FROM a JOIN rare USING (word) JOIN b USING (word) WHERE b.doc_id <> a.doc_id
GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2
"""


ORACLES["echo"] = echo_sql(
    "SELECT -1 - conv_id * 1000 - turn AS doc_id, text FROM conversations",
    ", string_agg(word, ' ' ORDER BY word) AS words",
)
ORACLES["echo_indexed"] = ORACLES["echo"]
ORACLES["echo_within"] = echo_sql("SELECT doc_id, text FROM documents", "")
ORACLES["resolved_rules"] = """
SELECT CASE lang WHEN 'en' THEN 'main' ELSE 'side' END AS game,
  CASE lang WHEN 'fr' THEN 'fr-report' ELSE 'brief' END AS profile, lang <> 'en' AS provisional,
  CASE lang WHEN 'en' THEN 'token,License' ELSE 'token' END AS protected,
  'thing>that,anthe>thering,that>thing' AS replace, 'queque,lichen,ciónado' AS keep,
  CASE lang WHEN 'fr' THEN 'Opening,Middle' ELSE '' END AS sections, 'straight' AS quotes,
  count(*) AS documents
FROM documents GROUP BY 1, 2, 3, 4, 7
"""
SKIPPED = """CASE profile WHEN 'de-report' THEN 'markers' WHEN 'fr-report' THEN 'consistency'
  WHEN 'brief' THEN 'structure,rhythm,soul' ELSE '' END"""
ORACLES["skipped_analyzers"] = f"""
WITH hd AS ({HEADED}), sc AS ({HINT_SCORES}), pr AS ({PROFILED})
SELECT profile, {SKIPPED} AS skipped, count(*) AS documents FROM pr GROUP BY 1, 2
"""

# ------------------------------------------------------------- edit gate

GATE = f"""
pairs AS ({PAIRS}),
src AS (SELECT DISTINCT text FROM (SELECT before AS text FROM pairs UNION ALL SELECT after FROM pairs)),
v AS ({MEASURED}),
items AS (
  SELECT text, 1 AS k, 'numbers' AS kind, tok AS item FROM (SELECT text, unnest({tokens('text')}) AS tok
    FROM src) WHERE regexp_matches(tok, '^[0-9]+$')
  UNION ALL SELECT text, 2, 'codes', tok FROM (SELECT text, unnest({tokens('text')}) AS tok FROM src)
    WHERE regexp_matches(tok, '^[0-9a-f]{{24,}}$')
  UNION ALL SELECT text, 3, 'mails', unnest(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) FROM src
  UNION ALL SELECT text, 4, 'token', tok FROM (SELECT text, unnest({tokens('text')}) AS tok FROM src)
    WHERE lower(tok) = 'token'
  UNION ALL SELECT text, 5, 'License', tok FROM (SELECT text, unnest({tokens('text')}) AS tok FROM src)
    WHERE lower(tok) = 'license'),
ic AS (SELECT text, k, kind, item, count(*) AS n FROM items GROUP BY 1, 2, 3, 4),
lost AS (SELECT pair_id, b.k, b.kind, b.item FROM pairs JOIN ic b ON b.text = before
         LEFT JOIN ic a ON a.text = after AND a.kind = b.kind AND a.item = b.item
         WHERE b.n > coalesce(a.n, 0)),
lk AS (SELECT pair_id, k, kind, list(item ORDER BY item) AS items FROM lost GROUP BY 1, 2, 3),
mm AS (SELECT pair_id, doc_id, edit, before, after, b AS bv, a AS av,
         100.0::DOUBLE * (length(after) - length(before)) / greatest(length(before), 1) AS delta
       FROM pairs JOIN v b ON b.text = before JOIN v a ON a.text = after),
viol AS (
  SELECT pair_id, 1 AS o, 'voice_lost' AS kind, 'address' AS signal, bv.address AS was, av.address AS now FROM mm WHERE av.address < bv.address
  UNION ALL SELECT pair_id, 2, 'voice_lost', 'imperative', bv.imperative, av.imperative FROM mm WHERE av.imperative < bv.imperative
  UNION ALL SELECT pair_id, 3, 'voice_lost', 'concession', bv.concession, av.concession FROM mm WHERE av.concession < bv.concession
  UNION ALL SELECT pair_id, 4, 'voice_lost', 'short_sentence', bv.short_sentence, av.short_sentence FROM mm WHERE av.short_sentence < bv.short_sentence
  UNION ALL SELECT pair_id, 5, 'voice_lost', 'parenthesis', bv.parenthesis, av.parenthesis FROM mm WHERE av.parenthesis < bv.parenthesis
  UNION ALL SELECT pair_id, 10 + k, 'protected_lost', kind, NULL, NULL FROM lk
  UNION ALL SELECT pair_id, 20, 'rhythm_flattened', NULL, NULL, NULL FROM mm WHERE av.ratio < bv.ratio - 0.03::DOUBLE
  UNION ALL SELECT pair_id, 21, 'text_shrunk', NULL, NULL, NULL FROM mm WHERE delta < -5),
vs AS (SELECT pair_id, string_agg(concat_ws('/', kind, signal, was, now), ';' ORDER BY o) AS violations
       FROM viol GROUP BY 1)
"""
ORACLES["voice_lost"] = f"""
WITH {GATE} SELECT pair_id, signal, was, now FROM viol WHERE kind = 'voice_lost'
"""
_STATE = (
    "CASE WHEN av.{0} < bv.{0} THEN 'removed' WHEN least(bv.words, av.words) < 150 "
    "THEN 'insufficient' ELSE 'kept' END"
)
_SIGNALS = ("address", "imperative", "concession", "short_sentence", "parenthesis")
ORACLES["voice_states"] = (
    f"WITH {GATE}, st AS ("
    + " UNION ALL ".join(
        f"SELECT edit, '{s}' AS signal, {_STATE.format(s)} AS state FROM mm" for s in _SIGNALS
    )
    + ") SELECT edit, signal, state, count(*) AS pairs FROM st GROUP BY 1, 2, 3"
)
ORACLES["protected_lost"] = f"""
WITH {GATE} SELECT pair_id, kind AS signal, 'пропало защищённое (' || kind || '): '
  || array_to_string(items[1:5], ', ') AS message FROM lk
"""
ORACLES["rhythm_flattened"] = f"""
WITH {GATE} SELECT pair_id FROM viol WHERE kind = 'rhythm_flattened'
"""
ORACLES["text_shrunk"] = f"WITH {GATE} SELECT pair_id FROM viol WHERE kind = 'text_shrunk'"
ORACLES["gate_verdicts"] = f"""
WITH {GATE}
SELECT pair_id, vs.pair_id IS NULL AS accepted, coalesce(violations, '') AS violations,
  {even('delta', 1)} AS length_change_pct, coalesce({even('bv.ratio', 3)}, -1) AS rhythm_before,
  coalesce({even('av.ratio', 3)}, -1) AS rhythm_after, coalesce({even('bv.per1k', 1)}, -1) AS voice_before,
  coalesce({even('av.per1k', 1)}, -1) AS voice_after
FROM mm LEFT JOIN vs USING (pair_id)
"""
ORACLES["gate_summary"] = f"""
WITH {GATE}, n AS (SELECT count(*) AS total FROM pairs)
SELECT kind, coalesce(signal, '') AS signal, count(DISTINCT pair_id) AS pairs, any_value(total) AS pairs_total,
       count(DISTINCT pair_id) * 100.0::DOUBLE / any_value(total) AS rate_pct
FROM viol, n GROUP BY 1, 2
"""
ORACLES["selected_attempts"] = f"""
WITH {GATE},
tries AS (SELECT mm.doc_id, CASE edit WHEN 'articles' THEN 1 WHEN 'digits' THEN 2 ELSE 3 END AS n,
            vs.pair_id IS NULL AS ok, after
          FROM mm LEFT JOIN vs USING (pair_id) WHERE edit <> 'parentheses'),
best AS (SELECT doc_id, min(n) FILTER (WHERE ok) AS n FROM tries GROUP BY 1)
SELECT d.doc_id, best.n IS NOT NULL AS accepted, CAST(coalesce(best.n, 0) AS BIGINT) AS accepted_n,
  md5(coalesce(trim(t.after, ' ' || chr(10)), d.text)) AS text,
  CAST(coalesce(best.n, 3) AS BIGINT) AS attempts,
  CASE WHEN best.n IS NULL THEN 'правка не прошла проверку за 3 — возвращён исходный текст' ELSE '' END
    AS caveat
FROM documents d JOIN best USING (doc_id) LEFT JOIN tries t ON t.doc_id = d.doc_id AND t.n = best.n
"""
ORACLES["edit_impact"] = f"""
WITH {GATE}, mk AS (
  SELECT text, len(regexp_extract_all(text, '!!+')) + len(regexp_extract_all(text,
    '(?i)(?:licensed under|all rights reserved|released under)'))
    + len(regexp_extract_all(text, 'token = "[0-9a-f]+"')) + len(regexp_extract_all(text, '[*#%&$]{{3,}}'))
    + len(regexp_extract_all(text, '\\|')) + len(regexp_extract_all(text,
    '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) AS n FROM src),
tp AS ({ORACLES["touched"]})
SELECT pair_id, touched_pct, delta AS length_change_pct, b.n AS markers_before, a.n AS markers_after,
  coalesce(bv.ratio, -1) AS rhythm_before, coalesce(av.ratio, -1) AS rhythm_after,
  coalesce(bv.per1k, -1) AS voice_before, coalesce(av.per1k, -1) AS voice_after
FROM mm JOIN mk b ON b.text = before JOIN mk a ON a.text = after JOIN tp USING (pair_id)
"""

# ------------------------------------------------------------------ jobs

AUDIT_DOCS = """
SELECT doc_id, lang, text || coalesce('. Keep the ' || o || '. Later drop the ' || o || ' and the ' || p_name
  || '.', '') AS text
FROM (SELECT *, p_name[1:2] || '''' || p_name[3:] AS o FROM part) RIGHT JOIN (%s) ON doc_id = p_partkey
""" % HEADED


def audit_rows(docs: str, service: bool = False, names: bool = True) -> str:
    """CTEs of an audit: ``fa`` holds all findings, ``pr`` the profiles."""
    profiled = (
        "SELECT *, CASE lang WHEN 'en' THEN 'en-report' ELSE 'fr-report' END AS profile FROM sc "
        "JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)"
        if service
        else PROFILED
    )
    structured = (
        f"hd AS ({docs}), sc AS ({HINT_SCORES}), pr AS ({profiled}), ln AS ({LINES}), "
        f"h AS ({HEADS}), s AS ({SECTIONS})"
    )
    parts = [
        "SELECT doc_id, 'markers.' || id AS id, line_no AS line, CASE action WHEN 'review' THEN "
        "'review' ELSE 'likely' END AS severity, 'markers' AS analyzer FROM hits JOIN pr USING "
        "(doc_id) WHERE profile <> 'de-report'",
        "SELECT doc_id, 'structure.missing.' || section_id, 0, 'likely', 'structure' FROM ms",
        "SELECT doc_id, 'consistency.variants', 0, 'likely', 'consistency' FROM vg JOIN pr USING "
        "(doc_id) WHERE profile <> 'fr-report'",
    ]
    if not service:
        parts.append(
            "SELECT doc_id, 'structure.matchups', 0, 'review', 'structure' FROM c "
            "WHERE evidence <> ''"
        )
    if names:
        only = "WHERE lang = 'en'" if service else ""
        parts.append(
            f"SELECT doc_id, 'cards.apostrophe', 0, 'error', 'cards' FROM (SELECT DISTINCT doc_id, "
            f"was, official FROM nw JOIN nk ON nk.key = lower(regexp_replace(was, '[''’ʼ`]', '', "
            f"'g')) WHERE lower(was) NOT IN (SELECT word FROM ow)) JOIN (SELECT doc_id FROM documents {only}) "
            "USING (doc_id)"
        )
        if not service:
            parts.append(
                "SELECT doc_id, 'consistency.advice', 0, 'review', 'consistency' FROM pr "
                "WHERE profile <> 'fr-report'"
            )
    return f"""
{structured}, {KNOWN}, {BODIES}, {COVERAGE}, {PROSE_TAIL}, {VARIANT_GROUPS},
dl AS (SELECT * FROM ln), hits AS ({HITS}), ms AS ({MISSING}),
nk AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS key,
         split_part(p_name, ' ', 1)[1:2] || '''' || split_part(p_name, ' ', 1)[3:] AS official FROM part),
nw AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_APOS}')) AS was FROM hd),
ow AS (SELECT official AS word FROM nk UNION SELECT unnest(string_split(p_name, ' ')[2:]) FROM part),
fa AS ({' UNION ALL '.join(parts)})
"""


def report_sql(service: bool) -> str:
    if service:
        skipped = "CASE lang WHEN 'en' THEN '' ELSE 'cards,consistency' END"
        notes = (
            "CASE lang WHEN 'en' THEN '' ELSE 'нормы предварительные: borrowed from main. Оценки "
            "ритма и живого — ориентир, а не эталон, пока не набран корпус текстов в этой игре' "
            "|| chr(10) || 'сверка имён отключена: no dictionary' END"
        )
        extra = f", {GAME} AS game, lang <> 'en' AS norms_provisional"
    else:
        skipped = SKIPPED
        notes = (
            "'профиль определён автоматически: ' || profile || ' (уверенность ' || confidence || "
            "'); указать явно — --profile' || CASE WHEN pr.words < "
            f"{MIN_WORDS} THEN chr(10) || pr.words || ' of ' || {MIN_WORDS} || ' words' ELSE '' END"
        )
        extra = ""
    on = "profile <> 'brief'"
    return f"""
WITH {audit_rows(AUDIT_DOCS, service)},
src AS (SELECT doc_id, text FROM hd), v AS ({MEASURED}),
g AS (SELECT doc_id, string_agg(severity || ':' || id || ':' || line, chr(10) ORDER BY
        CASE severity WHEN 'error' THEN 0 WHEN 'likely' THEN 1 ELSE 2 END, line, id) AS findings,
        count(*) FILTER (WHERE severity = 'error') AS error,
        count(*) FILTER (WHERE severity = 'likely') AS likely,
        count(*) FILTER (WHERE severity = 'review') AS review FROM fa GROUP BY 1)
SELECT pr.doc_id, profile, pr.words, coalesce(g.findings, '') AS findings, coalesce(error, 0) AS error,
  coalesce(likely, 0) AS likely, coalesce(review, 0) AS review, CAST(0 AS BIGINT) AS info,
  coalesce(CASE WHEN {on} THEN {even('ratio', 3)} END, -1) AS rhythm_ratio,
  coalesce(CASE WHEN {on} THEN {even('mean', 1)} END, -1) AS sentence_mean,
  coalesce(CASE WHEN {on} THEN {even('per1k', 1)} END, -1) AS voice_per_1k,
  {skipped} AS skipped, {notes} AS notes {extra}
FROM pr JOIN v USING (doc_id) LEFT JOIN g USING (doc_id)
"""


ORACLES["audit"] = report_sql(False)
ORACLES["analyze"] = report_sql(True)
ORACLES["report_json"] = f"""
WITH {audit_rows(AUDIT_DOCS)}
SELECT '1.0' AS schema_version, pr.doc_id, profile, count(fa.id) FILTER (WHERE severity = 'likely') AS likely,
  any_value(pr.words) AS words, count(fa.id) AS findings,
  'schema_version,document,profile,summary,metrics,findings,analyzers_skipped,notes' AS keys
FROM pr LEFT JOIN fa USING (doc_id) GROUP BY 2, 3
"""
ORACLES["findings_table"] = f"""
WITH {audit_rows(AUDIT_DOCS)}
SELECT analyzer, id, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents
FROM fa GROUP BY 1, 2, 3
"""
ORACLES["audit_stream_names"] = f"""
WITH {audit_rows(AUDIT_DOCS)}
SELECT doc_id, id, severity, CAST(line AS BIGINT) AS line FROM fa
"""
ORACLES["audit_repeated_ids"] = f"""
WITH {audit_rows(AUDIT_DOCS)}
SELECT pr.doc_id - pr.doc_id % 2 AS doc_id, any_value(pr.words) AS words,
       count(fa.id) FILTER (WHERE analyzer = 'cards') AS names, count(fa.id) AS findings
FROM pr LEFT JOIN fa USING (doc_id) GROUP BY pr.doc_id
"""
ORACLES["audit_stream"] = f"""
WITH {audit_rows(HEADED, names=False)}
SELECT doc_id, id, severity, CAST(line AS BIGINT) AS line FROM fa
"""
ORACLES["verdict_stream"] = f"""
WITH {GATE}
SELECT edit, vs.pair_id IS NULL AS accepted, count(*) AS pairs
FROM mm LEFT JOIN vs USING (pair_id) GROUP BY 1, 2
"""
ORACLES["severity_windows"] = f"""
WITH dl AS ({DOC_LINES}), hits AS ({HITS})
SELECT strftime(TIMESTAMP '1970-01-01' + to_hours(CAST(doc_id // 60 AS INT)), '%Y-%m-%d %H:%M') AS window_start,
  CASE action WHEN 'review' THEN 'review' ELSE 'likely' END AS severity, count(*) AS findings
FROM hits GROUP BY 1, 2
"""
