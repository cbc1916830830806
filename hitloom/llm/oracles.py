"""SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op5_urls": """
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
),
rules AS (
    SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rule_host, rule_path, rule_verdict)
),
numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
best AS (
    SELECT n, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
    FROM numbered JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM numbered LEFT JOIN best USING (n)
""",
    "op7_lm": """
WITH numbered AS (
    SELECT row_number() OVER () AS n, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
),
tokens AS (
    SELECT n, unnest(words) AS word, unnest(list_prepend(NULL, words[:-2])) AS before, unnest(range(len(words))) AS place
    FROM numbered WHERE len(words) > 0
),
word_counts AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
pair_counts AS (SELECT before, word, count(*) AS c FROM tokens WHERE place > 0 GROUP BY before, word),
scored AS (
    SELECT t.n,
           CAST(round(1000000 * ln(
               CASE WHEN t.place > 0 AND p.c >= 2 THEN p.c::DOUBLE / b.c
                    WHEN t.place > 0 THEN 0.4::DOUBLE * w.c / (SELECT count(*) FROM tokens)
                    ELSE w.c::DOUBLE / (SELECT count(*) FROM tokens) END)) AS BIGINT) AS s
    FROM tokens t JOIN word_counts w USING (word)
    LEFT JOIN word_counts b ON t.place > 0 AND b.word = t.before
    LEFT JOIN pair_counts p ON t.place > 0 AND p.before = t.before AND p.word = t.word
),
sums AS (SELECT n, CAST(sum(s) AS BIGINT) AS log_score FROM scored GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(log_score, 0) AS log_score,
       CASE WHEN len(words) > 0 THEN log_score / len(words) / 1000000 END AS mean_log_score
FROM numbered LEFT JOIN sums USING (n)
""",
    "op11_hard_negatives": """
WITH rows_ AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
),
ranked AS (
    SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
""",
    "op13_quality": """
WITH docs AS (
    SELECT row_number() OVER () AS n, doc_id, lang, text IS NULL AS missing, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
),
tokens AS (
    SELECT n, unnest(words) AS word, unnest(range(len(words))) AS place FROM docs WHERE len(words) > 0
),
windows AS (
    SELECT n, place, count(*) OVER (PARTITION BY n, a, b, c) AS times
    FROM (SELECT n, place, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM tokens WINDOW w AS (PARTITION BY n ORDER BY place))
    WHERE c IS NOT NULL
),
repeats AS (
    SELECT n, count(DISTINCT place + step) AS repeated FROM windows, range(3) AS s(step) WHERE times > 1 GROUP BY n
),
base AS (
    SELECT n, doc_id, lang, missing, len(words) AS n_words, length(text) AS n_chars, coalesce(repeated, 0) AS n_repeat_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           length(regexp_replace(text, '[^\\p{Ll}]', '', 'g')) AS lower,
           length(regexp_replace(text, '[^\\p{Lu}\\p{Lt}]', '', 'g')) AS upper,
           length(regexp_replace(text, '[^\\p{Lm}\\p{Lo}\\p{M}]', '', 'g')) AS letter,
           length(regexp_replace(text, '[^\\p{N}]', '', 'g')) AS number,
           length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) AS space,
           length(regexp_replace(text, '[^.,]', '', 'g')) AS stop,
           length(regexp_replace(text, '[^\\p{P}]', '', 'g')) - length(regexp_replace(text, '[^.,#*%&]', '', 'g')) AS punctuation,
           length(regexp_replace(text, '[^\\p{S}]', '', 'g')) - length(regexp_replace(text, '[^$|<>]', '', 'g')) AS symbol
    FROM docs LEFT JOIN repeats USING (n)
),
classes AS (
    SELECT n, lang, missing, unnest([lower, upper, letter, number, space, stop, punctuation, symbol, n_symbols,
                            n_chars - lower - upper - letter - number - space - stop - punctuation - symbol - n_symbols]) AS c,
           unnest(range(10)) AS bin
    FROM base
),
folded AS (
    SELECT n, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS c FROM tokens GROUP BY ALL
),
by_lang AS (SELECT lang, word, sum(f.c) AS c FROM folded f JOIN base USING (n) WHERE lang IS NOT NULL GROUP BY lang, word),
langs AS (SELECT lang, sum(c) AS total FROM by_lang GROUP BY lang),
common AS (
    SELECT lang, word, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS bin FROM by_lang
    QUALIFY bin <= 32
),
word_reference AS (
    SELECT lang, bin, c::DOUBLE / total AS share FROM common JOIN langs USING (lang)
    UNION ALL
    SELECT lang, 0, (total - sum(c))::DOUBLE / total FROM common JOIN langs USING (lang) GROUP BY lang, total
),
class_reference AS (
    SELECT lang, bin, sum(c)::DOUBLE / sum(sum(c)) OVER (PARTITION BY lang) AS share
    FROM classes JOIN langs USING (lang) WHERE NOT missing GROUP BY lang, bin
),
in_common AS (SELECT n, common.lang, bin, f.c FROM folded f JOIN common USING (word)),
word_shares AS (
    SELECT n, r.lang, r.bin, share AS q,
           CASE WHEN r.bin > 0 THEN coalesce(i.c, 0) ELSE n_words - coalesce(sum(i.c) OVER (PARTITION BY n, r.lang), 0) END::DOUBLE / n_words AS p
    FROM (SELECT n, n_words FROM base WHERE n_words >= 50) CROSS JOIN word_reference r LEFT JOIN in_common i USING (n, lang, bin)
),
class_shares AS (
    SELECT n, r.lang, bin, share AS q, c::DOUBLE / n_chars AS p
    FROM (SELECT n, n_chars FROM base WHERE n_chars >= 200) JOIN (SELECT n, bin, c FROM classes) USING (n) JOIN class_reference r USING (bin)
),
parts AS (
    SELECT 'word' AS kind, * FROM word_shares UNION ALL SELECT 'class', * FROM class_shares
),
distances AS (
    SELECT kind, n, lang, sqrt(greatest(0, sum(
        (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS distance
    FROM parts GROUP BY kind, n, lang
),
nearest AS (
    SELECT n, min(CASE WHEN kind = 'class' THEN distance END) AS by_class, min(CASE WHEN kind = 'word' THEN distance END) AS by_word
    FROM distances GROUP BY n
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(by_class <= 0.15 + sqrt(10 / (8 * n_chars * ln(2))), true)
                       AND coalesce(by_word <= 0.25 + sqrt(33 / (8 * n_words * ln(2))), true) AS kept
FROM failed LEFT JOIN nearest USING (n)
""",
}
