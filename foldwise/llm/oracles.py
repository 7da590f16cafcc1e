"""DuckDB SQL for the queries that SQL can express.  Where a query's operator is bound to a
hash or a tokenizer that SQL lacks, there is none, and ``tests/llm`` holds a brute-force version."""

from __future__ import annotations

from foldwise.llm import pareto_mix as mix
from foldwise.llm import quality_rules as rules
from foldwise.llm import url_trust as trust

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def top_k(k: int, every: int) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""


def quality() -> str:
    def test(r):
        ratio = f"{r.top}::DOUBLE >= {r.low!r}::DOUBLE * {r.bottom}::DOUBLE AND {r.top}::DOUBLE <= {r.high!r}::DOUBLE * {r.bottom}::DOUBLE"
        beyond = f" OR {r.beyond}::DOUBLE > {r.limit!r}::DOUBLE * word_chars::DOUBLE" if r.beyond else ""
        return f"({r.bottom} < {r.least} OR ({ratio}){beyond})"

    passed = " AND ".join(map(test, rules.RULES))
    stop = ", ".join(map(quoted, rules.STOP_WORDS))
    window = rules.WINDOW
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM documents),
windows AS (
  SELECT row, i, array_to_string(w[i:i + {window - 1}], ' ') AS g
  FROM (SELECT row, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
again AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + {window})) AS p FROM twice) GROUP BY row),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, {quoted(rules.SYMBOLS)}, '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"''()')) IN ({stop}))) AS n_stop_words,
    len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_same_words,
    len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_capital_words,
    length(regexp_replace(t, '[A-Za-z{rules.ACCENTED}\\P{{L}}]+', '', 'g')) AS n_other_letters,
    len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.][.][.]{SPACE}*$'))) AS n_dotted_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^{SPACE}*[-*•]'))) AS n_bullet_lines
  FROM d LEFT JOIN again USING (row)),
b AS (
  SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {passed} AS kept FROM b"""


def pareto() -> str:
    weights = "[" + ", ".join(f"{w}::DOUBLE" for w in mix.WEIGHTS) + "]"
    top = f"{float(16 ** mix.DIGITS)!r}::DOUBLE"
    fills = "".join(f""",
gap{k + 1} AS MATERIALIZED (
  SELECT source, any_value(cut) AS cut, any_value(gap0.gap) - coalesce(sum(more{k}.size), 0) AS gap
  FROM gap0 LEFT JOIN (SELECT size, source AS s FROM more{k}) more{k} ON s IS NOT DISTINCT FROM source GROUP BY source),
pick{k + 1} AS MATERIALIZED (
  SELECT x.row, x.size, x.source FROM summed x JOIN gap{k + 1} g ON g.source IS NOT DISTINCT FROM x.source
  WHERE z >= cut AND size > 0 AND {fits} AND x.row NOT IN (SELECT row FROM more{k})
  QUALIFY row_number() OVER (PARTITION BY x.source ORDER BY x.size {way}, z, key DESC, nth DESC) = 1),
more{k + 1} AS MATERIALIZED (SELECT * FROM more{k} UNION ALL SELECT * FROM pick{k + 1})""" for k, fits, way in (
        (k, *(("size <= gap", "DESC") if k < mix.FILL else ("size > gap AND size < 2 * gap", "")))
        for k in range(mix.FILL + 1)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}+'))::BIGINT AS size,
    md5(coalesce(text, '')) AS key, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS nth
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ({weights})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mix.WEIGHTS)}] AS weight
  FROM d GROUP BY source),
ranked AS (
  SELECT *, {mix.MOST_COPIES} * source_size::DOUBLE AS cap,
    row_number() OVER (ORDER BY {mix.MOST_COPIES} * source_size::DOUBLE / weight, source NULLS LAST) AS place FROM per),
levels AS (
  SELECT *, ({mix.SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked),
final AS (SELECT min_by(level, place) AS final FROM levels WHERE weight * level <= cap),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * final), cap) AS target FROM levels CROSS JOIN final),
plan AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END) AS whole,
    (CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END) - whole AS p,
    target - whole * source_size::DOUBLE AS rest
  FROM targets),
drawn AS (
  SELECT d.*, plan.source_size, target, whole, p, rest,
    (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), key, nth)), 1, {mix.DIGITS}))::BIGINT::DOUBLE + 0.5::DOUBLE) / {top} AS u,
    (u / (1 - u)) / (1.0::DOUBLE * (p / (1 - p))) AS odds, odds / (1 + odds) AS z
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
summed AS MATERIALIZED (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, z) AS own
  FROM drawn),
gap0 AS (
  SELECT source, min(z) AS cut, any_value(rest) - coalesce((SELECT max(s.upto) FROM summed s
    WHERE s.source IS NOT DISTINCT FROM x.source AND s.z < min(x.z)), 0) AS gap
  FROM summed x WHERE p > 0 AND rest > 0 AND upto > rest GROUP BY source),
more0 AS (SELECT -1::BIGINT AS row, 0::BIGINT AS size, NULL::VARCHAR AS source WHERE false){fills}
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN p > 0 AND (g.cut IS NULL OR z < g.cut OR row IN (SELECT row FROM more{mix.FILL + 1})) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed LEFT JOIN gap0 g ON g.source IS NOT DISTINCT FROM summed.source"""


def url_filter(rule_table) -> str:
    def ascii_lower(x):
        return f"translate({x}, '{trust.UPPER}', '{trust.LOWER}')"

    fits = [(f"((host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}))", h + p, v)
            for h, p, v in trust.longest_first(rule_table)]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {quoted(r)}" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN {quoted(v)}" for f, _, v in fits) + " END"
    parts, link = quoted(trust.PARTS), quoted(trust.LINK)
    keep, move = f"{1 - trust.DAMPING!r}::DOUBLE", f"{trust.DAMPING!r}::DOUBLE"
    steps = "".join(f""",
g{k + 1} AS MATERIALIZED (
  SELECT e.kind, dst AS host, sum(w * r) AS got, sum(w * u) AS of FROM share e JOIN r{k} ON r{k}.kind = e.kind AND r{k}.host = e.src
  GROUP BY ALL),
r{k + 1} AS (
  SELECT s.kind, s.host, s.seed * ({keep} + {move} * coalesce(of, 0)) + {move} * s.open * coalesce(got, 0) AS r,
    {keep} + {move} * coalesce(of, 0) AS u
  FROM seed s LEFT JOIN g{k + 1} g ON g.kind = s.kind AND g.host = s.host)""" for k in range(trust.ITERATIONS))
    return f"""
WITH p AS (
  SELECT page_id, {ascii_lower(f"regexp_extract(coalesce(url, ''), {parts}, 1)")} AS host,
    regexp_extract(coalesce(url, ''), {parts}, 2) AS path, coalesce(html, '') AS html FROM pages),
ruled AS (SELECT page_id, host, path, html, {rule} AS rule, {verdict} AS by_rule FROM p),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, {link}, 1)) AS link FROM p),
edges AS MATERIALIZED (
  SELECT src, dst, count(*)::DOUBLE AS w FROM (
    SELECT src, {ascii_lower(f"regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, {parts}, 1)")} AS dst
    FROM links) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
flow AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
seeds AS (
  SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust,
    avg(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host),
hosts AS (SELECT host FROM seeds UNION SELECT src FROM edges UNION SELECT dst FROM edges),
seed AS MATERIALIZED (
  SELECT kind, host, coalesce(CASE kind WHEN 'trust' THEN trust ELSE distrust END, 0) AS seed,
    greatest(0, 1 - coalesce(trust, 0) - coalesce(distrust, 0)) AS open
  FROM (SELECT unnest(['trust', 'distrust']) AS kind, host FROM hosts) LEFT JOIN seeds USING (host)),
share AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS w FROM flow),
r0 AS (SELECT kind, host, seed AS r, 1.0::DOUBLE AS u FROM seed){steps},
score AS (
  SELECT s.kind, s.host, round(s.seed + s.open * coalesce(got / of, 0), {trust.DECIMALS}) AS x
  FROM seed s LEFT JOIN g{trust.ITERATIONS} g ON g.kind = s.kind AND g.host = s.host),
bad AS (
  SELECT host FROM score GROUP BY host
  HAVING sum(CASE WHEN kind = 'distrust' THEN x ELSE 0 END) - sum(CASE WHEN kind = 'trust' THEN x ELSE 0 END) >= {trust.THRESHOLD})
SELECT page_id, host, path, rule,
  coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM ruled"""
