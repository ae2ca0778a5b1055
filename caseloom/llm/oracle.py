"""SQL for the pN_ queries that SQL can express; the others are tested on small fixtures."""

from __future__ import annotations

_SOURCE = """lower(trim(dataset)) || chr(1) || trim(regexp_replace(lower(trim(source_id)), '^\\./', ''))"""

_FORM = """nullif(regexp_replace(regexp_replace({0}, '[\\[\\]【】［］()（）,，、\\s\u00a0\u2000-\u200b\u202f\u205f\u3000\ufeff]', '', 'g'), '罪$', ''), '')"""

_CANDIDATES = f"""
listed AS (SELECT charge, target_share, min_rows, {_FORM.format("charge")} AS form FROM charge_targets WHERE charge IS NOT NULL),
keyed AS (SELECT t.ref_no, coalesce(t.id, chr(1) || t.ref_no) AS id, l.charge AS category
          FROM (SELECT ref_no, id, {_FORM.format("charge")} AS form FROM train_references WHERE split = 'train') t JOIN listed l USING (form)),
once AS (SELECT id, arg_min(category, ref_no) AS category FROM keyed GROUP BY id),
n AS (SELECT category, count(*) AS n FROM once GROUP BY category),
size AS (SELECT floor(round(0.1 * (SELECT count(*) FROM once), 6)) AS s),
quota AS (SELECT l.charge, l.target_share, l.min_rows, coalesce(n.n, 0) AS n_rows,
          CAST(greatest(coalesce(l.min_rows, 0), ceil(round(coalesce(l.target_share, 0) * s, 6))) AS BIGINT) AS wanted
          FROM listed l CROSS JOIN size LEFT JOIN n ON n.category = l.charge)"""


_POINT = "('0x' || md5({0} || '|42')[1:13])::BIGINT / 4503599627370496.0"

_ASSIGNED = f"""
k AS (SELECT ref_no, 's' || {_SOURCE} AS k FROM train_references WHERE dataset IS NOT NULL AND source_id IS NOT NULL UNION ALL SELECT ref_no, 'i' || id FROM train_references WHERE id IS NOT NULL),
hub AS (SELECT k, min(ref_no) AS h FROM k GROUP BY k), edge AS (SELECT DISTINCT ref_no AS a, h AS b FROM k JOIN hub USING (k) WHERE ref_no <> h), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT ref_no AS a, ref_no AS b FROM train_references UNION SELECT reach.a, w.b FROM reach JOIN both_ways w ON reach.b = w.a),
comp AS (SELECT a AS ref_no, min(b) AS first_key FROM reach GROUP BY a),
cum AS (SELECT split, sum(share / (SELECT sum(share) FROM split_targets WHERE share > 0 AND split IS NOT NULL)) OVER (ORDER BY split) AS upto, row_number() OVER (ORDER BY split DESC) = 1 AS last FROM split_targets WHERE share > 0 AND split IS NOT NULL),
assigned AS (SELECT ref_no, first_key, (SELECT min(split) FROM cum WHERE last OR {_POINT.format("comp.first_key")} < upto) AS new_split FROM comp)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_assigned": f"WITH RECURSIVE {_ASSIGNED} SELECT ref_no, first_key, new_split FROM assigned",
        "p4_shares": f"""WITH RECURSIVE {_ASSIGNED}, n AS (SELECT new_split AS split, count(*) AS n FROM assigned GROUP BY 1)
SELECT split, share / (SELECT sum(share) FROM split_targets WHERE share > 0) AS target_share, coalesce(n, 0) AS n_rows, coalesce(n, 0) / (SELECT sum(n) FROM n) AS share FROM split_targets LEFT JOIN n USING (split) WHERE split IS NOT NULL""",
        "p5_sample": f"""WITH {_CANDIDATES}, f AS (SELECT id, min(ref_no) AS ref_no FROM keyed GROUP BY id), d AS (SELECT f.ref_no, once.id, once.category, row_number() OVER (PARTITION BY category ORDER BY {_POINT.format("f.ref_no")}, f.ref_no) AS r FROM f JOIN once USING (id))
SELECT d.ref_no, t.id, d.category AS charge FROM d JOIN quota ON quota.charge = d.category JOIN train_references t USING (ref_no) WHERE r <= wanted""",
        "p5_shares": f"""WITH {_CANDIDATES}, d AS (SELECT *, least(wanted, n_rows) AS n_drawn FROM quota)
SELECT charge, target_share, min_rows, n_rows, wanted, n_drawn, n_drawn / (SELECT sum(n_drawn) FROM d) AS reached_share, wanted - n_drawn AS deficit FROM d""",
        "p4_found": f"""
WITH t AS (SELECT ref_no, split, {_SOURCE} AS src FROM train_references WHERE dataset IS NOT NULL AND source_id IS NOT NULL AND split IS NOT NULL)
SELECT ref_no FROM t WHERE src IN (SELECT src FROM t GROUP BY src HAVING count(DISTINCT split) > 1)""",
        "p5_found": f"WITH {_CANDIDATES} SELECT charge FROM quota WHERE n_rows < wanted",
        "p5_quotas": f"WITH {_CANDIDATES} SELECT charge, target_share, min_rows, n_rows, wanted, greatest(wanted - n_rows, 0) AS deficit FROM quota",
    }
