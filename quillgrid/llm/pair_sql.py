"""DuckDB's versions of the queries on groups and pairs of texts: plain comparisons of all texts that share a member.

They are meant for the small tables on which results are compared, and share nothing with the operators but the
problem's definition.
"""

from __future__ import annotations

#: The labels of a block of labelled fields.
LABELS = ("TITLE", "DESCRIPTION", "SOURCE", "LANGUAGE", "CODE")


def _squash(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^\\pL\\pN]+', '', 'g')"


def _real(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^\\s\\pZ]'), false)"


def _forms() -> str:
    """CTEs up to ``same`` (a, b): each entry and the first one that agrees with it in a form of its content."""
    label = "(?im)^([\\t\\p{Zs}]*(?:" + "|".join(LABELS) + ")[\\t\\p{Zs}]*:)"
    return f"""e AS (SELECT DISTINCT entry_id, {_squash('title')} AS head, content FROM documentation_entry WHERE entry_id IS NOT NULL AND {_real('title')} AND {_real('content')}),
    j AS (SELECT entry_id, head, content FROM e WHERE CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' ELSE false END),
    leaf AS (SELECT j.entry_id, j.head, j.content, {_squash('t.fullkey')} || ':' || {_squash("coalesce(t.atom ->> '$', 'null')")} AS leaf FROM j, json_tree(j.content) AS t WHERE t.type NOT IN ('OBJECT', 'ARRAY')),
    parts AS (SELECT entry_id, head, list_filter(list_transform(string_split(regexp_replace(content, '{label}', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_squash('x')}), lambda x: x <> '') AS own FROM e WHERE regexp_matches(content, '{label}')),
    form AS (SELECT entry_id, 'flat' AS kind, head, {_squash('content')} AS form FROM e
        UNION ALL SELECT entry_id, 'json', head, string_agg(leaf, chr(1) ORDER BY leaf) FROM leaf GROUP BY entry_id, head, content
        UNION ALL SELECT entry_id, 'fields', head, array_to_string(list_sort(own), chr(1)) FROM parts),
    same AS (SELECT entry_id AS a, min(entry_id) OVER (PARTITION BY kind, head, form) AS b FROM form)"""


def _alike(rows: str, id_col: str) -> str:
    """CTEs up to ``alike`` (a, b), both ways: ids of ``rows`` whose contents are alike, those of equal sets included;
    ``own`` has each id's class and ``near`` the classes that are alike."""
    three = "list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])"
    return f"""words AS (SELECT {id_col} AS id, regexp_extract_all(upper(content), '[\\pL\\pN]+') AS ws FROM {rows} WHERE {id_col} IS NOT NULL AND content IS NOT NULL),
    sets AS (SELECT DISTINCT id, list_sort(list_distinct(CASE WHEN len(ws) > 2 THEN {three} ELSE [array_to_string(ws, ' ')] END)) AS members FROM words WHERE len(ws) > 0),
    own AS (SELECT id, min(id) OVER (PARTITION BY members) AS class, members FROM sets),
    member AS (SELECT id AS class, len(members) AS size, unnest(members) AS m FROM own WHERE id = class),
    near AS (SELECT x.class AS a, y.class AS b FROM member x JOIN member y ON x.m = y.m AND x.class <> y.class GROUP BY x.class, y.class, x.size, y.size HAVING count(*) >= 0.7 * (x.size + y.size - count(*)) - 1e-9
        UNION ALL SELECT class, class FROM own WHERE id = class),
    alike AS (SELECT x.id AS a, y.id AS b FROM near JOIN own x ON x.class = near.a JOIN own y ON y.class = near.b WHERE x.id <> y.id)"""


#: Ids reached from each id over ``link``, both ways, and the smallest of them.
_REACH = """reach AS (SELECT a AS id, a AS other FROM link UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other),
    grouped AS (SELECT id, min(other) AS first_id, count(*) AS n FROM reach GROUP BY id)"""

_SAME = f"WITH RECURSIVE {_forms()}, link AS (SELECT a, b FROM same UNION SELECT b, a FROM same), {_REACH}"

P1_FOUND = f"{_SAME} SELECT first_id, id AS copy_id FROM grouped WHERE id <> first_id"
P1_COPIES = f"{_SAME} SELECT first_id, count(*) AS copies FROM grouped GROUP BY 1"

P5_FOUND = f"""WITH RECURSIVE {_forms()}, {_alike('documentation_entry', 'entry_id')},
    class_link AS (SELECT id AS a, class AS b FROM own UNION SELECT a, b FROM near UNION SELECT a, b FROM same), link AS (SELECT a, b FROM class_link UNION SELECT b, a FROM class_link), {_REACH}
    SELECT first_id AS group_id, id AS entry_id FROM grouped WHERE n > 1"""


def p2_found(cutoff: str) -> str:
    """Rows after the cutoff that are alike an earlier one are taken one by one: each is refused if one of the alike
    rows before it hasn't been."""
    return f"""WITH RECURSIVE job AS (SELECT job_id, min(created_at) AS made FROM ingestion_job WHERE job_id IS NOT NULL GROUP BY 1),
    batch AS (SELECT cache_id, content, made FROM embedding_cache JOIN job USING (job_id) WHERE made IS NOT NULL), {_alike('batch', 'cache_id')},
    turn AS (SELECT cache_id, made, row_number() OVER (ORDER BY made, cache_id) AS place FROM batch),
    waiting AS (SELECT row_number() OVER (ORDER BY min(x.place)) AS n, a AS id, list(b) AS before FROM alike JOIN turn x ON x.cache_id = a JOIN turn y ON y.cache_id = b WHERE y.place < x.place AND x.made >= TIMESTAMP '{cutoff}' GROUP BY a),
    taken AS (SELECT 0::bigint AS n, []::bigint[] AS refused UNION ALL SELECT w.n, CASE WHEN len(list_filter(w.before, lambda x: NOT list_contains(taken.refused, x))) > 0 THEN list_append(taken.refused, w.id) ELSE taken.refused END FROM taken JOIN waiting w ON w.n = taken.n + 1),
    final AS (SELECT unnest(refused) AS id FROM (SELECT refused FROM taken ORDER BY n DESC LIMIT 1))
    SELECT DISTINCT least(w.id, w.b) AS cache_id_a, greatest(w.id, w.b) AS cache_id_b FROM (SELECT id, unnest(before) AS b FROM waiting) w WHERE w.id IN (FROM final) AND w.b NOT IN (FROM final)"""
