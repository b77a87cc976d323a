"""SQL that gives the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle_sql(levels: int = 7, top_levels: int = 4) -> str:
    """One step per level: enough for 8 ** levels rows of a language and 8 ** top_levels languages."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v})) || ':' || {v} END" for v in (
            "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    def tree(name: str, steps: int) -> str:
        """name_0(lang, number, node, n) is given; runs of children and the nodes above them, level by level."""
        out = ""
        for k in range(steps):
            out += f""",
{name}_run{k} AS (SELECT lang, number // 8 AS run, string_agg(node, '' ORDER BY number) AS s FROM {name}_{k} WHERE n > 1 GROUP BY ALL),
{name}_{k + 1} AS (SELECT lang, run AS number, sha256(s) AS node, count(*) OVER (PARTITION BY lang) AS n FROM {name}_run{k})"""
        return out

    def climb(name: str, at: str, start: str, steps: int) -> tuple[str, str]:
        """Per level the joined run, then what the proof and the folded node become."""
        out, now = "", start
        for k in range(steps):
            child = f"(({at} // {8 ** k}) % 8)"
            out += f""",
{name}_up{k} AS (SELECT b.* REPLACE (CASE WHEN s IS NULL THEN proof ELSE proof || s[:{child} * 64] || s[{child} * 64 + 65:] END AS proof,
  CASE WHEN s IS NULL THEN folded ELSE sha256(s[:{child} * 64] || folded || s[{child} * 64 + 65:]) END AS folded)
  FROM {now} b LEFT JOIN {name}_run{k} r ON {'b.lang IS NOT DISTINCT FROM r.lang AND ' if name == 'low' else ''}{at} // {8 ** (k + 1)} = r.run)"""
            now = f"{name}_up{k}"
        return out, now

    low, after_low = climb("low", "b.number", "begun", levels)
    top, after_top = climb("top", "b.place", "lifted", top_levels)
    roots = " UNION ALL ".join(f"SELECT lang, node FROM low_{k} WHERE n = 1" for k in range(levels + 1))
    top_root = " UNION ALL ".join(f"SELECT node FROM top_{k} WHERE n = 1" for k in range(top_levels + 1))
    return f"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS cells FROM steps WHERE k = 8),
given AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, x: xor(a >> 8, cells[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0, false) AS hit
  FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number FROM given),
low_0 AS (SELECT lang, number, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed){tree('low', levels)},
subroots AS ({roots}),
top_0 AS (SELECT 0 AS lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS number, node, count(*) OVER () AS n, lang AS name FROM subroots){tree('top', top_levels)},
begun AS (SELECT doc_id, lang, number, leaf, '' AS proof, CASE WHEN hit THEN lowered ELSE leaf END AS folded FROM placed){low},
lifted AS (SELECT b.*, t.number AS place, t.node AS subroot FROM {after_low} b JOIN top_0 t ON b.lang IS NOT DISTINCT FROM t.name){top}
SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.node AS verified
FROM {after_top}, ({top_root}) root(node)"""


DIVERGENCE_SQL = f"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')), '{UPPER}', '{LOWER}') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (t.total + v.terms) AS p
  FROM total t JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(whole) + any_value(terms)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS whole FROM total GROUP BY lang) USING (lang) GROUP BY ALL),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200"""


REPEATS_SQL = """
WITH d AS (SELECT doc_id, text, hex(encode(text)) AS data, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS id
  FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
pieces AS (SELECT id, base, data[2 * base + 1:2 * base + 598] AS piece FROM (SELECT id, data, unnest(range(0, length(data) // 2 - 99, 200)) AS base FROM d)),
s AS (SELECT id, base + i AS i, md5(piece[2 * i + 1:2 * i + 200]) AS string FROM (SELECT *, unnest(range(length(piece) // 2 - 99)) AS i FROM pieces)),
later AS (SELECT id, i FROM s QUALIFY row_number() OVER (PARTITION BY string ORDER BY id, i) > 1),
starts AS (SELECT *, i - lag(i) OVER (PARTITION BY id ORDER BY i) AS step FROM later),
spans AS (SELECT id, min(i) AS first, max(i) + 100 AS stop
  FROM (SELECT *, count(*) FILTER (step IS NULL OR step > 100) OVER (PARTITION BY id ORDER BY i) AS span FROM starts) GROUP BY id, span),
cuts AS (SELECT id, first, stop, lag(stop, 1, 0) OVER (PARTITION BY id ORDER BY first) AS since FROM spans),
gone AS (SELECT id, sum(stop - first) AS n_removed, count(*) AS n_spans, max(stop) AS last,
  string_agg(d.data[2 * since + 1:2 * first], '' ORDER BY first) AS before FROM cuts JOIN d USING (id) GROUP BY id),
made AS (SELECT doc_id, text, n_removed, n_spans, sha256(unhex(coalesce(before, '') || data[2 * coalesce(last, 0) + 1:])) AS sha FROM d LEFT JOIN gone USING (id))
SELECT d.doc_id, octet_length(encode(m.text)) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha AS kept_sha256
FROM documents d JOIN made m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND coalesce(d.text, '') = m.text"""
