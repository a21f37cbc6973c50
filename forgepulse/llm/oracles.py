"""SQL (DuckDB) that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from .mixing import SCHEDULES, WEIGHTS
from .quality_rules import BOILERPLATE
from .url_filters import RULES, TRACKING

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) t(i)),
 least_id AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
 gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least_id USING (g), range(13) r(k) WHERE m < doc_id),
 word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
 kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_BOILER = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 gram AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) t(i)),
 again AS (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
 line AS (SELECT doc_id, unnest(lines) AS l FROM d),
 fact AS (SELECT doc_id, l, len({_WORDS.format(text="l")}) AS n, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS solid FROM line),
 lost AS (SELECT doc_id, sum(n) AS n FROM fact WHERE solid > 0 AND (NOT regexp_matches(l, '[.!?…。！？]') OR len(regexp_extract_all(l, '[#*$%&|<>{{}}\\^~_=!?]')) * 10 > solid OR len(regexp_extract_all(l, '[|»›·•→]|>|::')) * 4 >= greatest(n, 4) OR {_BOILER}) GROUP BY doc_id),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM fact WHERE n > 0 GROUP BY doc_id),
 r AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_lost_words <= 0.5 * n_words AS kept, n_lost_words FROM r"""


def _cycle(values) -> str:
    return f"[{', '.join(f'{float(v)}::DOUBLE' for v in values)}][CAST(place % {len(values)} + 1 AS INTEGER)]"


_A, _B = _cycle([a for a, _ in SCHEDULES]), _cycle([b for _, b in SCHEDULES])
MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="text")}) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
 w AS (SELECT *, {_cycle(WEIGHTS)} AS weight FROM s),
 lv AS (SELECT *, ((1.5::DOUBLE * sum(source_size) OVER ()) - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS soon
 FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, place)),
 one AS (SELECT arg_min(level, soon) AS level FROM lv WHERE NOT level * weight >= 2 * source_size),
 t AS (SELECT source, place, source_size, CASE WHEN one.level IS NULL OR one.level * weight >= 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE one.level * weight END AS target FROM lv LEFT JOIN one ON true),
 c AS (SELECT doc_id, size, source_size, target, place, CAST(floor(target) AS BIGINT) AS words, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 k AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes, ({_B} - {_A}) / ({_B} + {_A}) AS a, CASE WHEN words > 0 THEN start / words END AS x FROM c),
 e AS (SELECT *, CAST(passes * size + least(greatest(words - passes * source_size - start, 0), size) AS BIGINT) AS taken FROM k)
 SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE WHEN abs(a) < 1e-9 THEN x ELSE least(greatest((-(1 - a) + sqrt(pow(1 - a, 2) + 4 * a * x)) / (2 * a), 0), 1) END, 6) + 0::DOUBLE END AS position FROM e"""

_BIT = "(CASE {x} WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END)"
_EACH = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {a})"
FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format(text="text")} AS w FROM documents),
 m AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
 doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM d),
 c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
 o AS (SELECT a || b || c || d || e AS filter_order FROM {_EACH.format(a="a")}, {_EACH.format(a="b")}, {_EACH.format(a="c")}, {_EACH.format(a="d")}, {_EACH.format(a="e")} WHERE len(list_distinct([a, b, c, d, e])) = 5),
 s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, {_BIT.format(x="substr(filter_order, step, 1)")} AS bit, list_sum(list_transform(range(1, step), lambda i: {_BIT.format(x="substr(filter_order, CAST(i AS INTEGER), 1)")})) AS ahead FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
 r AS (SELECT part, filter_order, letter, CAST(step AS INTEGER) AS step, coalesce(sum(n) FILTER (WHERE mask & bit = 0 AND mask & h = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & h = 0), 0) AS removed,
 coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & h > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & h = 0), 0) AS good_lost,
 coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & h = 0), 0) AS toxic_lost FROM c, (SELECT *, CAST(coalesce(ahead, 0) AS BIGINT) AS h FROM s) GROUP BY ALL)
 SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""

_FIT = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_SAYS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
#: The tables' html names no url, so a class is the spellings of one url; escapes and dot segments, which they don't have either, stay.
URL_FILTERS = rf"""WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
 r AS (SELECT *, CASE {_FIT} END AS rule, regexp_replace(regexp_replace(host, '^[^@]*@', ''), '\.?(:(80|443)?)?$', '') || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') || '?' || array_to_string(list_filter(string_split(query, '&'), lambda x: NOT regexp_matches(x, '^({TRACKING})(=|$)')), '&') AS node FROM u),
 o AS (SELECT *, CASE rule {_SAYS} END AS own FROM r),
 a AS (SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS alias FROM o WHERE contains(url, '://') GROUP BY node)
 SELECT page_id, host, path, rule, coalesce(own, alias, 'allow') AS verdict FROM o LEFT JOIN a ON o.node = a.node AND contains(o.url, '://')"""
