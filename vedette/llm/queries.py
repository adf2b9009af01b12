"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module of each query.
MODULES = {
    "op1_lattice_likelihood": "lattice",
    "op2_bm25_wand": "decontaminate",
    "op3_interval_tree": "repeats",
    "op4_progressive_jpeg": "media",
    "op5_template_compiler": "chat",
    "op7_character_network": "secrets",
    "op8_minhash_star": "minhash",
    "op9_conditional_random_field": "langid",
    "op10_bradley_terry": "quality",
    "op6_concatenate_and_cut": "packing",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"vedette.llm.{module}"), name) for name, module in MODULES.items()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: Every document's set, all pairs that share a shingle, and what each document reaches over the links.
NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id::BIGINT AS doc_id, {_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
size AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh ON sh.doc_id = w.doc_id GROUP BY w.doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * both_.n >= 85 * (x.n + y.n - both_.n)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT reach.doc_id, any_value(size.n)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = reach.doc_id AS kept FROM reach JOIN size ON size.doc_id = reach.doc_id GROUP BY reach.doc_id"""

#: Every window of 100 bytes of every text (as hexadecimal digits), which of them come earlier too, their union.
REPEATS = """WITH d AS (SELECT doc_id::BIGINT AS doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
block AS (SELECT doc_id, 500 * b AS head, substr(x, 1000 * b + 1, 1200) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 1000 + 1)) AS b FROM d)),
win AS (SELECT doc_id, head + j AS i, md5(substr(y, 2 * j + 1, 200)) AS h FROM (SELECT doc_id, head, y, unnest(range(0, least(500, len(y) // 2 - 99))) AS j FROM block)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM again)),
span AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM run GROUP BY doc_id, k),
cut AS (SELECT span.doc_id, b, e, substr(x, 2 * lag(e, 1, 0) OVER o + 1, 2 * (b - lag(e, 1, 0) OVER o)) AS before, CASE WHEN lead(b) OVER o IS NULL THEN substr(x, 2 * e + 1) ELSE '' END AS after
  FROM span JOIN d ON d.doc_id = span.doc_id WINDOW o AS (PARTITION BY span.doc_id ORDER BY b)),
found AS (SELECT doc_id, sum(e - b) AS removed, count(*) AS spans, string_agg(before || after, '' ORDER BY b) AS kept FROM cut GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN found ON found.doc_id = d.doc_id"""

#: Digests from the table itself, and the length that the template's marks and escapes make.
CONVERSATIONS = r"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, len(regexp_extract_all(text, '\\|###|</turn>')) AS t, len(regexp_extract_all(role, '\\|###|</turn>|:')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(role) + r + length(': ') + length(text) + t + length(' </turn>') + 1)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_interval_tree": REPEATS, "op5_template_compiler": CONVERSATIONS, "op8_minhash_star": NEAR_DUPLICATES}
