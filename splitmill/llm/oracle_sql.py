"""DuckDB SQL for the queries of the text operators that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ITEM_WORDS = f"regexp_extract_all({LOWER.format('text')}, " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def url_filters(rules: list[tuple[str, bool]]) -> str:
    values = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{'block' if b else 'allow'}')" for r, b in rules)
    return f"""
    WITH u AS (SELECT page_id, {LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r(rule, rhost, rpath, verdict) AS (VALUES {values})
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""


SUBSTRING = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
    win AS (SELECT x.doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM x JOIN d USING (doc_id)),
    f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE first < doc_id),
    g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
    k AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN g USING (doc_id)),
    o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM d),
    s AS (SELECT o.doc_id, string_agg(d.w[o.p], ' ' ORDER BY o.p) AS kept FROM o JOIN d USING (doc_id) LEFT JOIN gone USING (doc_id, p)
          WHERE gone.p IS NULL GROUP BY o.doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM k LEFT JOIN s USING (doc_id)"""


def chat(own: str) -> str:
    return rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '{own}'), (-7, 1, 'assistant', '{own}')),
    n AS (SELECT *, CASE WHEN regexp_full_match(role, '[a-z_]+') THEN length(role) ELSE 1 + 2 * strlen(role) END AS role_n,
                 CASE WHEN contains(text, '\') OR regexp_matches(text, '(?i)### [a-z0-9_%]*:|</turn>')
                      THEN length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</', ''))) / 2
                           + len(list_filter(range(1, length(text)), lambda i: text[i] = '#' AND text[i + 1] = '#'))
                      ELSE length(text) END AS text_n FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(role_n + text_n + {len("### ") + len(":n") + len("</turn>n")}) AS BIGINT) AS formatted_chars
    FROM n GROUP BY conv_id"""


DECONTAMINATE = f"""
    WITH it AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
    iw AS (SELECT item_id, w, least(10, len(w)) AS n FROM it WHERE len(w) > 0),
    ix AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM iw),
    tw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM ix),
    d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
    l AS (SELECT DISTINCT n FROM tw),
    dx AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN l ON len(w) >= n),
    dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dx JOIN d USING (doc_id)),
    hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN tw USING (n, g)),
    p AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
    c AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""


FILL_IN_MIDDLE = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                      sha256('7:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
    h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
                 CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                 CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, coalesce(array_to_string(u[1:i], ''), '') AS p, coalesce(array_to_string(u[i + 1:j], ''), '') AS m, coalesce(array_to_string(u[j + 1:n], ''), '') AS s FROM f)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(p || m || s) AS restored_sha256
    FROM p"""


def quality(least: int = 20, words_left: int = 10, lost: float = 0.7) -> str:
    space = r"[\x20\x09-\x0D]"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    x AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five FROM x JOIN d USING (doc_id)),
    again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
    l AS (SELECT doc_id, host, text, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
    s AS (SELECT doc_id, host, text, trim(regexp_replace(regexp_replace(lower(line), '{space}+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS line,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, line AS given FROM l),
    f AS (SELECT host, line FROM s GROUP BY host, line HAVING count(DISTINCT text) >= {least}),
    gone AS (SELECT doc_id, sum(n) AS n FROM s JOIN f USING (host, line) GROUP BY doc_id),
    twice AS (SELECT doc_id, count(*) - count(DISTINCT given) AS n FROM s GROUP BY doc_id),
    o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(twice.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
                 CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
          FROM d LEFT JOIN r USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN twice USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
    SELECT *, NOT base_failed AND n_words - n_line_words >= {words_left} AND n_line_words <= {lost} * n_words AS kept FROM b"""
