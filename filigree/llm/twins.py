"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .decontaminate import WINDOW

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(name: str, table: str, key: str, pattern: str, ahead: int) -> str:
    """Words w0 with their place i and number n, and the words w1, w2, ... that follow (null beyond the end)."""
    leads = ", ".join(f"lead(w0, {k}) OVER (PARTITION BY row ORDER BY i) AS w{k}" for k in range(1, ahead))
    split = f"SELECT {key}, row_number() OVER () AS row, regexp_extract_all({_LOWER}, '{pattern}') AS ws FROM {table}"
    return f"{name} AS (SELECT *, {leads} FROM (SELECT {key}, row, len(ws) AS n, unnest(ws) AS w0, generate_subscripts(ws, 1) AS i FROM ({split})))"


def _joined(size: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"w{k}" for k in range(size)) + ")"


def decontamination(width: int = WINDOW) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    of_size = " UNION ALL ".join(f"SELECT doc_id, i, size, item_id FROM dw JOIN win ON size = {k} AND win.words = {_joined(k)} WHERE w{k - 1} IS NOT NULL" for k in range(1, width + 1))
    return f"""WITH {_words("dw", "documents", "doc_id", pattern, width)}, {_words("iw", "benchmark", "item_id", pattern, width)},
win AS (SELECT DISTINCT item_id, least(n, {width}) AS size, {_joined(width)} AS words FROM iw WHERE i <= greatest(n - {width - 1}, 1)),
hit AS ({of_size}),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1),
wo AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY 1),
al AS (SELECT doc_id, max(n) AS n_words FROM dw GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN al USING (doc_id) LEFT JOIN wo USING (doc_id) LEFT JOIN it USING (doc_id)"""


def jaccard_components(width: int = 5, percent: int = 80) -> str:
    return f"""WITH RECURSIVE {_words("dw", "documents", "doc_id", r"[^\x20\x09-\x0D]+", width)},
sh AS (SELECT DISTINCT doc_id, {_joined(width)} AS g FROM dw WHERE i <= greatest(n - {width - 1}, 1)),
si AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
co AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
li AS (SELECT a, b FROM co JOIN si p ON a = p.doc_id JOIN si q ON b = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
ed AS (SELECT a, b FROM li UNION ALL SELECT b, a FROM li),
re AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM re JOIN ed ON other = a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN si USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM re GROUP BY 1) USING (doc_id)"""


def repeated_bytes(length: int = 100) -> str:
    """Texts as hexadecimal digits, cut into chunks of length bytes (and length - 1 more) so that a window costs the same
    at every place of a text."""
    return f"""WITH tx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
ch AS (SELECT doc_id, c * {length} AS base, substr(h, c * {2 * length} + 1, {4 * length - 2}) AS part FROM (SELECT doc_id, h, unnest(range(len(h) // {2 * length} + 1)) AS c FROM tx)),
wi AS (SELECT doc_id, base + j AS start, substr(part, 2 * j + 1, {2 * length}) AS w FROM (SELECT *, unnest(range(least({length}, len(part) // 2 - {length - 1}))) AS j FROM ch WHERE len(part) >= {2 * length})),
la AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) AS k FROM wi) WHERE k > 1),
la2 AS (SELECT doc_id, start, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) > {length}, true) AS fresh FROM la),
sp AS (SELECT doc_id, run, min(start) AS s, max(start) + {length} AS e FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM la2) GROUP BY 1, 2),
ke AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM sp UNION ALL SELECT doc_id, NULL, coalesce(max(e), 0), max(len(h)) // 2 FROM tx LEFT JOIN sp USING (doc_id) GROUP BY doc_id),
kt AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept FROM ke JOIN tx USING (doc_id) GROUP BY 1),
ns AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM sp GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM tx LEFT JOIN ns USING (doc_id) JOIN kt USING (doc_id)"""


def fill_middle() -> str:
    cut = "CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form"
    draw = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    part = "substr(text, 1, lo) AS p, substr(text, lo + 1, hi - lo) AS m, substr(text, hi + 1) AS s"
    return f"""WITH tx AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
dr AS (SELECT doc_id, text, length(text) AS n, {draw} FROM tx),
pl AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi, {cut} FROM dr),
pa AS (SELECT *, {part} FROM pl),
ou AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM pa)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM ou"""


ORACLE_SQL = {"op11_fill_middle": fill_middle(), "op1_run_index": repeated_bytes(), "op4_decontaminate": decontamination(), "op5_near_copies": jaccard_components(), "op8_jaccard_join": jaccard_components()}
