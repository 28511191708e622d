"""DuckDB SQL for the corpus queries that SQL can express."""

#: Terms by a regular expression, counts of every (lang, source) for every kept term of the lang, exact integer shares.
OP11 = r"""
WITH rows_ AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
     words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows_),
     kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
     groups_ AS (SELECT DISTINCT lang, source FROM rows_),
     counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
     cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS everywhere
               FROM groups_ g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     totals AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(everywhere) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM cells),
     p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (everywhere + 5)) // (lang_total + 5 * v)::HUGEINT AS q FROM totals),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
               FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
