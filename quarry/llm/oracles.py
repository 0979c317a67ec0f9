"""DuckDB twins of the operator queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op6_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END) AS g
            FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) c ON c.node = d.doc_id""",
    "op7_url_filters": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
        s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        r(rule, rule_host, rule_path, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM s JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
        SELECT s.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '(^|[^a-z0-9_])(cheap-pills|free-bets|spam-farm|ads-track)($|[^a-z0-9_])') OR regexp_matches(host || path, '^[^/]*(^|[^a-z0-9_])casino-[a-z0-9]')
            OR regexp_matches(host || path, '^[^/]*/.*\badult\b') THEN 'block' ELSE 'allow' END) AS verdict FROM s LEFT JOIN m USING (page_id)""",
    "op8_phrase_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        s AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
        x AS (SELECT k, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
        c AS (SELECT k, p, w[p] AS word, EXISTS (SELECT 1 FROM x WHERE x.k = d.k AND x.i BETWEEN p - 34 AND p) AS gone FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
        t AS (SELECT k, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (k)""",
    "op10_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) WHERE len(w) >= 3),
        x AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1)),
        r AS (SELECT k, sum(least(3, coalesce(j - i, 3))) AS n FROM x GROUP BY 1),
        l AS (SELECT k, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))) AS x FROM d),
        f AS (SELECT k, x, length(replace(x, ' ', '')) AS size, len({_WORDS.format("x")}) AS n, substr(x, 2, 2) AS s FROM l),
        b AS (SELECT k, count(*) - count(DISTINCT x) AS dups, coalesce(sum(size) FILTER ((n >= 10 AND NOT regexp_matches(x, '[.!?;:"'')\]]|[\p{{Thai}}\p{{Lao}}]') AND NOT regexp_matches(translate(x, chr(123) || '#%&*,/@\(-_)[]}}•·§¶†‡', ''), '[\p{{Po}}\p{{Pe}}\p{{Pf}}]')) OR (n >= 3 AND (length(x) - length(translate(x, '|»›•', ''))) * 4 >= n)
            OR (n >= 4 AND size >= 20 AND s = upper(s) AND x = upper(x) AND x <> lower(x)) OR (length(x) - length(translate(x, '#*$%&|<>', ''))) * 10 >= size), 0) AS lost FROM f GROUP BY 1),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS BIGINT) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
            coalesce(dups, 0) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars FROM d LEFT JOIN b USING (k) LEFT JOIN r USING (k))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept, lost_chars FROM m""",
    "op13_fill_middle": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS s, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        n AS (SELECT *, len(s) - CASE WHEN s[-1] = '' THEN 1 ELSE 0 END AS n FROM d),
        c AS (SELECT *, least(('0x' || substr(h, 1, 8))::UBIGINT % (n + 1), ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1))::BIGINT AS lo, greatest(('0x' || substr(h, 1, 8))::UBIGINT % (n + 1), ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1))::BIGINT AS hi,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
        e AS (SELECT *, CASE WHEN lo = n THEN t WHEN lo = 0 THEN '' ELSE array_to_string(s[:lo], chr(10)) || chr(10) END AS p, CASE WHEN hi = n THEN t WHEN hi = 0 THEN '' ELSE array_to_string(s[:hi], chr(10)) || chr(10) END AS q FROM c),
        f AS (SELECT *, substr(q, length(p) + 1) AS m, substr(t, length(q) + 1) AS x FROM e)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""",
}
