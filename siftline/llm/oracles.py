"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6 = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), item AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark) WHERE len(w) > 0
), gram AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM item)
), win AS (
  SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM doc, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)
), hit AS (SELECT r, win.n, i, item FROM win JOIN gram ON win.g = gram.g AND win.n = gram.n
), pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""

_SHUT = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

OP8 = rf"""
WITH t AS (
  SELECT conv_id, (conv_id & 1) = 0 AS chosen, (conv_id - (conv_id & 1)) // 2 AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), e AS (
  SELECT *, regexp_replace({_SHUT.format("role")}, '\|(\\*)>', '|\\\1>', 'g') AS r, {_SHUT.format("text")} AS x FROM t
), p AS (
  SELECT *, '<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10) AS piece, len(x) + 8 AS body FROM e
), both_sides AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM p WHERE chosen) a FULL JOIN (SELECT * FROM p WHERE NOT chosen) b ON a.pair_id = b.pair_id AND a.k = b.k
), common AS (
  SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS n FROM both_sides GROUP BY pair_id
), rest AS (
  SELECT p.*, n, sum(len(piece)) OVER (PARTITION BY conv_id ORDER BY k) AS stop FROM p JOIN common USING (pair_id) WHERE k > n
), side AS (
  SELECT pair_id, chosen, string_agg(piece, '' ORDER BY k) AS completion, string_agg((stop - body) || ':' || stop, ',' ORDER BY k) FILTER (role = 'assistant') AS loss FROM rest GROUP BY pair_id, chosen
), head AS (
  SELECT pair_id, max(conv_id) FILTER (chosen) AS chosen_id, max(conv_id) FILTER (NOT chosen) AS rejected_id, min(n) AS n,
    string_agg(piece, '' ORDER BY k) FILTER (chosen AND k <= n) AS prompt
  FROM p JOIN common USING (pair_id) GROUP BY pair_id
)
SELECT head.pair_id, chosen_id, rejected_id, CAST(n AS INT) AS n_common, coalesce(prompt, '') AS prompt, coalesce(a.completion, '') AS chosen_completion, coalesce(a.loss, '') AS chosen_loss,
  coalesce(b.completion, '') AS rejected_completion, coalesce(b.loss, '') AS rejected_loss
FROM head LEFT JOIN side a ON a.pair_id = head.pair_id AND a.chosen LEFT JOIN side b ON b.pair_id = head.pair_id AND NOT b.chosen
"""

ORACLES: dict[str, str] = {"op6_decontaminate": OP6, "op8_preferences": OP8}
