"""SQL twins (DuckDB) of the queries that SQL can express."""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"substr('{_BASE32}', (((('0x' || substr(hex, {5 * k + 1}, 5))::INTEGER) >> {shift}) & 31) + 1, 1)"
    for k in range(8) for shift in (15, 10, 5, 0)
)

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
"""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


# Each source's documents in order, one after the other: a copy more for each that fits into what is left.
OP5 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, source_size::DOUBLE * 2 AS cap FROM s),
b AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total,
        (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER o, 0) AS left_words,
        sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, left_words * weight >= cap * left_weight AS stops FROM b),
f AS (SELECT *, total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS free_words,
        sum(CASE WHEN stops THEN 0.0::DOUBLE ELSE weight END) OVER () AS free_weight FROM c),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE free_words * weight / free_weight END AS target FROM f),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS certain FROM t),
l AS (SELECT d.source, list({{'id': doc_id, 'size': size}} ORDER BY u, doc_id NULLS LAST, size) AS docs FROM d GROUP BY d.source),
g AS (SELECT r.*, list_reduce(docs, lambda a, x: CASE WHEN x.size <= a.room
               THEN {{'room': a.room - x.size, 'docs': list_append(a.docs, {{'id': x.id, 'size': x.size, 'extra': 1}})}}
               ELSE {{'room': a.room, 'docs': list_append(a.docs, {{'id': x.id, 'size': x.size, 'extra': 0}})}} END,
             {{'room': floor(target - (certain * source_size)::DOUBLE)::BIGINT, 'docs': []::STRUCT(id BIGINT, size BIGINT, extra INTEGER)[]}}).docs AS docs
      FROM r JOIN l ON r.source IS NOT DISTINCT FROM l.source),
x AS (SELECT source_size, target, certain, unnest(docs) AS doc FROM g)
SELECT doc.id AS doc_id, doc.size AS size, source_size, target, (doc.size * (certain + doc.extra))::BIGINT AS taken FROM x
"""


OP7 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS passage FROM w),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY passage ORDER BY doc_id, start) > 1 AS repeat FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM r WHERE repeat),
p AS (SELECT doc_id, list(place) AS places FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(words) AS n, array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i)), ' ') AS kept, len(places) AS gone
      FROM d JOIN p USING (doc_id)
      UNION ALL SELECT doc_id, len(words), array_to_string(words, ' '), 0 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, n::BIGINT AS n_words, gone::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS rid FROM documents),
v AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS pos FROM d WHERE len(words) >= 8),
w AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, words[pos:pos + 7]) AS times FROM v),
r AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(pos, pos + 8)) AS place FROM w WHERE times > 1) GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols::DOUBLE / greatest(n_words, 1) AS s,
        n_dup_lines::DOUBLE / greatest(n_lines, 1) AS l, word_chars::DOUBLE / greatest(n_words, 1) AS c FROM m),
u AS (SELECT lang, source, floor(least(s, 64) * 1024) / 1024 AS s, floor(least(l, 64) * 1024) / 1024 AS l, floor(least(c, 64) * 1024) / 1024 AS c FROM f WHERE NOT base_failed),
g AS (SELECT grouping(lang) AS no_lang, grouping(source) AS no_source, lang, source, count(*) AS n, list_sort(list(s)) AS s, list_sort(list(l)) AS l, list_sort(list(c)) AS c
      FROM u GROUP BY GROUPING SETS ((lang, source), (lang), ())),
q AS (SELECT no_lang, no_source, lang, source, n, (ceil(n * (1 - 0.85::DOUBLE)))::INTEGER AS lo, (ceil(n * 0.5::DOUBLE))::INTEGER AS mid, (ceil(n * 0.85::DOUBLE))::INTEGER AS hi, s, l, c FROM g WHERE n > 0),
h AS (SELECT no_lang, no_source, lang, source, n, s[mid] + 3::DOUBLE * greatest(s[hi] - s[mid], 0.02::DOUBLE) AS s_high, l[mid] + 3::DOUBLE * greatest(l[hi] - l[mid], 0.15::DOUBLE) AS l_high,
        c[mid] + 3::DOUBLE * greatest(c[hi] - c[mid], 1::DOUBLE) AS c_high, c[mid] - 3::DOUBLE * greatest(c[mid] - c[lo], 1::DOUBLE) AS c_low FROM q),
j AS (SELECT f.*, h.s_high, h.l_high, h.c_high, h.c_low, row_number() OVER (PARTITION BY rid ORDER BY no_lang + no_source) AS k
      FROM f JOIN h ON (no_source = 0 AND no_lang = 0 AND h.n >= 30 AND h.lang IS NOT DISTINCT FROM f.lang AND h.source IS NOT DISTINCT FROM f.source)
        OR (no_source = 1 AND no_lang = 0 AND h.n >= 30 AND h.lang IS NOT DISTINCT FROM f.lang) OR no_lang = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND s <= s_high AND l <= l_high AND c <= c_high AND c >= c_low AS kept FROM j WHERE k = 1
"""

OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, words, unnest([1, 2, 3, 4]) AS size FROM w WHERE len(words) > 0),
g AS (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS pos FROM s WHERE len(words) >= size),
f AS (SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM f WHERE size > 1),
x AS (SELECT c.lang, c.size, c.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:k], ' ')
             JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(words[k + 1:c.size], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, f, string_split(phrase, ' ') AS words, size, unnest(range(2, size)) AS part FROM f WHERE size > 2),
i AS (SELECT lang, f, words, part, unnest(range(1, size - part + 2)) AS pos FROM o),
u AS (SELECT lang, array_to_string(words[pos:pos + part - 1], ' ') AS phrase, max(f) AS longer FROM i GROUP BY ALL),
e AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
      FROM m LEFT JOIN u ON u.lang = m.lang AND u.phrase = m.phrase
      WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT e.lang, rank, phrase, a, l, r, n, score FROM e JOIN t ON t.lang = e.lang WHERE rank <= 2000
"""

ORACLE_SQL = {"op2_warc": OP2, "op5_mixing": OP5, "op7_repeats": OP7, "op10_quality": OP10, "op11_collocations": OP11}
