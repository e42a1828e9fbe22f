"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from stemtable.llm.chat_format import BUDGET, CONTROL, END, HISTORY, MARKS, START, TOKEN
from stemtable.llm.collocations import LEAST, LONGEST, PERCENT, TOP
from stemtable.llm.mixing import MOST, WEIGHTS
from stemtable.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

# The sample is a running sum over the whole source here; the operator reaches it by bins.
MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS id, md5(coalesce(text, '')) AS mark,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 10) AS BIGINT) + 0.5) / {float(1 << 40)!r} AS u
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    list_extract({list(WEIGHTS)}, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)) AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, {MOST} * source_size AS cap, row_number() OVER (ORDER BY {MOST} * source_size / weight, source ASC NULLS LAST) AS k
  FROM sizes
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM ordered
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(
    (SELECT arg_min(l.level, l.k) FROM levels l WHERE l.level * l.weight < l.cap) * weight, CAST(cap AS DOUBLE))) AS target
  FROM levels
), goals AS (
  SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS ratio FROM targets)
), heights AS (
  SELECT g.source, d.size, count(*) AS n, any_value(g.rest) AS rest FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
  WHERE d.size > 0 AND g.rest > 0 GROUP BY g.source, d.size
), scaled AS (
  SELECT *, (rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(CAST(n * size * size AS DOUBLE)) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS c FROM heights
), scales AS (
  SELECT source, arg_max(c, size) AS c FROM scaled WHERE c * size < 1 GROUP BY source
), drawn AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.rest, s.c, least(1E0, s.c * d.size) AS p
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN scales s ON d.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS rank FROM drawn
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, id, mark, size ROWS UNBOUNDED PRECEDING) AS total FROM ranked
), copied AS (
  SELECT *, CAST(whole AS BIGINT) + CASE WHEN size > 0 AND rest > 0 AND c IS NOT NULL AND total - size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM summed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies, copies * CAST(size AS BIGINT) AS taken
FROM copied"""
def vector_codes() -> str:
    """Every distance of every round, from dot products of whole numbers in doubles."""

    def nearest(t: int) -> str:
        return f"""near{t} AS MATERIALIZED (
  SELECT rid, p, x, near % {ENTRIES} AS e, near // {ENTRIES} AS d FROM (
    SELECT c.rid, c.p, any_value(c.x) AS x, min(CAST(
      list_dot_product(c.x, c.x) - 2 * list_dot_product(c.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) * {ENTRIES} + b.e) AS near
    FROM cut c JOIN book{t} b USING (p) GROUP BY c.rid, c.p)
)"""

    def moved(t: int) -> str:
        return f"""book{t + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{t} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST(sum(CAST(v AS BIGINT)) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{t}) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e
)"""

    steps = [step for t in range(ROUNDS) for step in (nearest(t), moved(t))] + [nearest(ROUNDS)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v,
    row_number() OVER (ORDER BY vec_id ASC NULLS LAST) AS rid
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)
), book0 AS MATERIALIZED (
  SELECT p, rid - 1 AS e, x FROM cut WHERE rid <= {ENTRIES}
), {", ".join(steps)}, coded AS (
  SELECT rid, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, CAST(unnest(x) AS BIGINT) AS v, generate_subscripts(x, 1) AS i FROM book{ROUNDS})
)
SELECT k.vec_id, lower(c.code) AS code, c.error,
  CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, g.codebooks_sha256
FROM kept k JOIN coded c USING (rid), digest g"""


# Conversation -7 of the formatting query: control strings as texts.
PROBE = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def chat_format() -> str:
    """What goes in is what must be read back; the windows only count for ``formatted_chars``."""
    size = f"""{len(START) + len(END) + 2} + length(replace(replace(role, '~', '~~'), chr(10), '~n'))
    + len(regexp_extract_all(role, '[<\\[]\\\\*(?:{CONTROL})')) + length(text) + len(regexp_extract_all(text, '[<\\[]\\\\*(?:{CONTROL})'))"""
    probe = ", ".join(map(str, PROBE))
    return f"""
WITH every AS (
  SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {probe})
), sized AS (
  SELECT *, len(regexp_extract_all(text, '{TOKEN}')) + len(regexp_extract_all(role, '{TOKEN}')) + {MARKS} AS tokens, {size} AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS k
  FROM every
), placed AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) AS BIGINT) AS ends,
    max(CASE WHEN k = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS kept
  FROM sized
), strided AS (
  SELECT *, greatest(CAST(floor(({BUDGET - HISTORY} - kept) / 2) AS BIGINT), {HISTORY}) AS stride FROM placed
), windows AS (
  SELECT conv_id, min(ends - tokens) AS starts FROM strided GROUP BY conv_id, (ends - 1) // stride, tokens <= stride
), repeated AS (
  SELECT s.conv_id, sum(s.size) AS chars FROM strided s JOIN windows w
  ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.starts >= s.ends AND (CASE WHEN s.k = 1 AND s.kept > 0 THEN true ELSE w.starts <= s.ends - s.tokens + {HISTORY} END)
  GROUP BY s.conv_id
)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(p.size) + coalesce(any_value(r.chars), 0) AS BIGINT) AS formatted_chars
FROM placed p LEFT JOIN repeated r ON p.conv_id IS NOT DISTINCT FROM r.conv_id
GROUP BY p.conv_id"""


def collocations() -> str:
    """Every phrase of every piece is written out and counted."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = " UNION ALL ".join(
        f"SELECT g.lang, g.phrase, g.m, {k} AS k, g.a, array_to_string(g.w[1:{k}], ' ') AS lw, array_to_string(g.w[{k + 1}:], ' ') AS rw "
        f"FROM candidates g WHERE g.m > {k}"
        for k in range(1, LONGEST)
    )
    inside = " UNION ALL ".join(
        f"SELECT lang, array_to_string(w[i:i + {size - 1}], ' ') AS phrase, a FROM candidates, range(1, {LONGEST + 1}) t(i) WHERE m > {size} AND i + {size - 1} <= m"
        for size in range(2, LONGEST)
    )
    ahead = ", ".join(f"lead(w1, {k}) OVER p AS w{k + 1}" for k in range(1, LONGEST))
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, {" || ' ' || ".join(f'w{k}' for k in range(1, m + 1))} AS phrase FROM ahead WHERE w{m} IS NOT NULL"
        for m in range(1, LONGEST + 1)
    )
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
  FROM documents
), placed AS (
  SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT lang, w, row_number() OVER () AS piece FROM pieces)
), ahead AS (
  SELECT lang, w1, {ahead} FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)
), counts AS MATERIALIZED (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM ({grams}) GROUP BY lang, m, phrase
), totals AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT * FROM counts WHERE m > 1 AND a >= {LEAST}
), parts AS MATERIALIZED (
  SELECT concat(lang, chr(10), phrase) AS name, a FROM counts WHERE a >= {LEAST}
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM ({inside}) GROUP BY lang, phrase
), cuts AS (
  SELECT c.*, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM ({cut}) c JOIN parts l ON concat(c.lang, chr(10), c.lw) = l.name JOIN parts r ON concat(c.lang, chr(10), c.rw) = r.name
  JOIN totals t ON c.lang = t.lang
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n,
  CAST(score AS BIGINT) AS score
FROM worst w LEFT JOIN inside i ON w.lang = i.lang AND w.phrase = i.phrase
WHERE i.longer IS NULL OR 100 * i.longer < {PERCENT} * w.a
QUALIFY rank <= {TOP}"""
