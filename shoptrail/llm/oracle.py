"""DuckDB SQL of those queries that SQL can express; the others are tested by brute force."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_MTREE = """
WITH v AS (
    SELECT DISTINCT vec_id,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (
          PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""

_MIXING = rf"""
WITH sized AS (
    SELECT doc_id, source,
           CAST(coalesce(len(regexp_extract_all(text, '{_SPACE}')), 0) AS BIGINT) AS size
    FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
    SELECT *, 3.0::DOUBLE * source_size AS full_size,
           CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
    FROM sizes),
placed AS (
    SELECT *, row_number() OVER (ORDER BY full_size / weight, source NULLS LAST) AS place
    FROM weighted),
levels AS (
    SELECT p.place, p.weight, p.full_size,
           ((SELECT sum(source_size) FROM placed)
            - coalesce((SELECT sum(full_size) FROM placed b WHERE b.place < p.place), 0))
           / (SELECT sum(weight) FROM placed c WHERE c.place >= p.place) AS level
    FROM placed p),
chosen AS (
    SELECT level FROM levels WHERE level * weight <= full_size ORDER BY place LIMIT 1),
goals AS (
    SELECT source, source_size,
           least(full_size, (SELECT level FROM chosen) * weight) AS target FROM placed),
rated AS (
    SELECT s.doc_id, s.size, g.source_size, g.target,
           CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
           CAST('0x' || substr(md5('42:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 12)
                AS BIGINT) / 281474976710656.0::DOUBLE AS draw
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT)
           AS taken
FROM rated"""


# Stated here anew, not taken from the library: phrases with their labels and values.
_BASE = [("cc by", "cc-by", 0.9), ("general public license", "gpl", 0.4),
         ("all rights reserved", "reserved", 0.0)]
_NOTICES = [
    ("mit license", "mit", 1.0), ("permission is hereby granted free of charge", "mit", 1.0),
    ("apache license", "apache", 1.0), ("bsd license", "bsd", 1.0),
    ("redistribution and use in source and binary forms", "bsd", 1.0),
    ("isc license", "isc", 1.0), ("mozilla public license", "mpl", 0.7),
    ("eclipse public license", "epl", 0.7), ("lesser general public license", "lgpl", 0.6),
    ("affero general public license", "agpl", 0.2), ("cc by nc", "cc-by-nc", 0.2),
    ("cc by nd", "cc-by-nd", 0.3), ("cc by sa", "cc-by-sa", 0.6), ("cc0 1 0", "cc0", 1.0),
    ("public domain", "public-domain", 1.0), ("proprietary and confidential", "proprietary", 0.0),
]


def _licenses() -> str:
    base = " UNION ALL ".join(
        f"SELECT r, CAST(i - 1 AS BIGINT) AS word, '{label}' AS label FROM split,"
        f" unnest(range(1, len(w) + 1)) AS t(i)"
        f" WHERE w[i:i + {len(phrase.split()) - 1}] = {phrase.split()}"
        for phrase, label, _ in _BASE
    )
    every = ", ".join(
        f"CASE WHEN contains(s, ' {phrase} ') THEN struct_pack(l := '{label}', f := {value}) END"
        for phrase, label, value in _NOTICES + _BASE
    )
    return rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_ALNUM}') AS w
    FROM documents),
places AS ({base}),
found AS (
    SELECT r, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM places GROUP BY r),
labelled AS (
    SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
           list_filter([{every}], lambda x: x IS NOT NULL) AS hits
    FROM (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS s FROM split))
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.l))), ',')
           AS labels,
       CAST(coalesce(list_min(list_transform(hits, lambda x: x.f)), 0) AS DOUBLE) AS score
FROM labelled LEFT JOIN found USING (r)"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (
    SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN first USING (html)"""

_NEAR = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id"""

_SUBSTRINGS = rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(text, '{_SPACE}'), []) AS w FROM documents),
words AS (
    SELECT r, i, w[i] AS word,
           CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS win
    FROM split, unnest(range(1, len(w) + 1)) AS t(i)),
repeated AS (SELECT win FROM words WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
marked AS (
    SELECT r, i, word, max(CASE WHEN p.win IS NOT NULL THEN 1 ELSE 0 END) OVER (
        PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM words LEFT JOIN repeated p USING (win)),
kept AS (
    SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS text
    FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split LEFT JOIN kept k USING (r)"""

_QUALITY = rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           coalesce(regexp_extract_all(text, '{_SPACE}'), []) AS w FROM documents),
windows AS (
    SELECT r, i, w[i:i + 4] AS win FROM split, unnest(range(1, len(w) - 3)) AS t(i)),
repeated AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows)
    WHERE n > 1),
covered AS (
    SELECT r, count(DISTINCT i + j) AS n FROM repeated, unnest(range(0, 5)) AS t(j) GROUP BY r),
measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           list_filter(string_split(text, chr(10)),
                       lambda x: regexp_matches(x, '{_SPACE}')) AS lines,
           coalesce(n, 0) AS n_repeat_words
    FROM split LEFT JOIN covered USING (r)),
counted AS (
    SELECT *, CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
    FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words
            OR (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM counted"""

_PHRASES = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
grams AS (
    SELECT lang, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
        || list_transform(range(1, len(w) - 1),
                          lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS p
    FROM split),
f AS MATERIALIZED (
    SELECT lang, p, count(*) AS f, string_split(p, ' ') AS w, len(string_split(p, ' ')) AS size
    FROM grams GROUP BY lang, p HAVING count(*) >= 10),
cut AS MATERIALIZED (
    SELECT lang, p AS phrase, f AS a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y
    FROM f WHERE size > 1
    UNION ALL
    SELECT lang, p, f, 2, array_to_string(w[:2], ' '), w[3] FROM f WHERE size = 3),
cuts AS (
    SELECT c.lang, phrase, a, k, l.f AS l, r.f AS r,
           CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM cut c JOIN f l ON l.lang = c.lang AND l.p = c.x
    JOIN f r ON r.lang = c.lang AND r.p = c.y),
best AS (
    SELECT * FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
    SELECT lang, f AS a, array_to_string(w[:2], ' ') AS phrase FROM f WHERE size = 3
    UNION ALL
    SELECT lang, f, array_to_string(w[2:], ' ') FROM f WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS longest FROM inner_parts GROUP BY lang, phrase),
whole AS (
    SELECT b.* FROM best b LEFT JOIN longer USING (lang, phrase)
    WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (
          PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM whole)
JOIN totals USING (lang) WHERE rank <= 2000"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_LEXICAL = rf"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS w
    FROM documents),
docs AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
lengths AS (
    SELECT r, doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM docs, totals),
counts AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM words)
    GROUP BY r, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT)
               AS weight
    FROM counts, totals GROUP BY term, docs),
items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term
    FROM benchmark),
scored AS (
    SELECT item_id, r, doc_id,
           CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r)
    GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (
          PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored WHERE score > 0)
WHERE rank <= 10"""

ORACLE_SQL = {
    "op2_mtree": _MTREE,
    "op3_mixing": _MIXING,
    "op5_licenses": _licenses(),
    "op6_warc": _WARC,
    "op7_near_vectors": _NEAR,
    "op10_substrings": _SUBSTRINGS,
    "op11_quality": _QUALITY,
    "op12_phrases": _PHRASES,
    "op13_lexical": _LEXICAL,
}
