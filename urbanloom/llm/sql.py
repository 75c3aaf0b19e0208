"""DuckDB SQL of the queries that SQL can express on whole tables."""

from .url_filter import GENERAL, LOWER, RULES, UPPER


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _rule(value: int) -> str:
    longest = sorted(RULES, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=True)
    return "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{(h + p, v)[value]}'" for h, p, v in longest) + " END"


def _moments(level: str) -> str:
    return f"""SELECT '{level}' AS level, sum(bad) / sum(n) AS mean, 1 / least(greatest(coalesce((sum(bad * bad / n) - sum(n) * pow(sum(bad) / sum(n), 2) - (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)) * (count(*) - 1))
      / nullif((sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)) * (sum(n) - sum(n * n) / sum(n) - count(*) + 1), 0), 0.01), 0.005), 0.9) - 1 AS s FROM (SELECT {level}, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM k WHERE n > 0 GROUP BY {level})"""


SQL: dict[str, str] = {
    "op6_url_filter": f"""WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS a FROM pages), r AS (SELECT page_id, a, regexp_extract(a, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(a, length(raw) + 1), '^[^?#]*') AS path FROM r),
    e AS (SELECT host, count(*) AS n, sum(1 - quality) AS bad FROM p JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY host),
    d AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p),
    c AS (SELECT d.host, name, string_split(name, '.') AS l, CAST(coalesce(n, 0) AS DOUBLE) AS n, CAST(coalesce(bad, 0) AS DOUBLE) AS bad FROM d LEFT JOIN e ON e.host = d.host),
    g AS (SELECT *, regexp_full_match(name, '[0-9.]+') OR starts_with(name, '[') AS ip, CASE WHEN len(l) >= 3 AND regexp_full_match(l[-1], '[a-z]{{2}}') AND l[-2] IN {GENERAL} THEN 2 ELSE 1 END AS m FROM c),
    k AS (SELECT host, n, bad, CASE WHEN ip THEN 'ip' ELSE array_to_string(l[greatest(len(l) - m + 1, 1):], '.') END AS suffix, CASE WHEN ip THEN name ELSE array_to_string(l[greatest(len(l) - m, 1):], '.') END AS domain FROM g),
    s1 AS ({_moments('suffix')}), s2 AS ({_moments('domain')}), s3 AS ({_moments('host')}),
    ra AS (SELECT suffix, (sum(bad) + any_value(s) * any_value(mean)) / (sum(n) + any_value(s)) AS rate FROM k, s1 WHERE n > 0 GROUP BY suffix),
    rb AS (SELECT domain, (sum(bad) + any_value(s) * any_value(ra.rate)) / (sum(n) + any_value(s)) AS rate FROM s2, k JOIN ra USING (suffix) WHERE n > 0 GROUP BY domain),
    x AS (SELECT host, (bad + coalesce(s3.s, 1.0) * coalesce(rb.rate, ra.rate, s1.mean, 0)) / (n + coalesce(s3.s, 1.0)) AS rate, n + coalesce(s3.s, 1.0) AS w FROM s1, s3, k LEFT JOIN ra USING (suffix) LEFT JOIN rb USING (domain))
    SELECT page_id, host, path, {_rule(0)} AS rule, coalesce({_rule(1)}, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)) > 0.35 THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN x USING (host)""",
}
