"""DuckDB SQL for the driver queries, written over the source tables alone."""

from __future__ import annotations

LOG = """log AS (SELECT *, CASE WHEN vt = 2 THEN lpad(CAST(user_id + 5 AS VARCHAR), 6, '0') END AS end_k FROM (
  SELECT CASE WHEN value < 50 THEN 0 ELSE 1 END AS cf_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS k, event_id + 1 AS seq, user_id,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type IN ('view', 'click') THEN 3
         WHEN event_type = 'error' AND event_id % 10 = 0 THEN 2 ELSE 0 END AS vt,
    CASE WHEN event_type = 'error' THEN '' ELSE substr(event_type, 1, 1) END AS v, CAST(floor(value) AS BIGINT) AS n FROM events))"""


def resolved(as_of: int | None = None, fold: str = "string_agg(v, '' ORDER BY seq)", value: str = "coalesce(base, '') || coalesce(ops, '')", v: str = "v", source: str = LOG) -> str:
    """CTEs up to r(cf_id, k, val), the visible keys of the log."""
    cut = f"AND seq <= {as_of}" if as_of is not None else ""
    return f"""WITH {source},
pt AS (SELECT * FROM log WHERE vt <> 2 {cut}), rt AS (SELECT * FROM log WHERE vt = 2 {cut}),
cov AS (SELECT p.cf_id, p.k, coalesce(max(r.seq), 0) AS rs FROM (SELECT DISTINCT cf_id, k FROM pt) p
        LEFT JOIN rt r ON r.cf_id = p.cf_id AND r.k <= p.k AND p.k < r.end_k GROUP BY ALL),
b AS (SELECT cf_id, k, max(seq) AS bs, arg_max(vt, seq) AS bvt, arg_max({v}, seq) AS bv FROM pt WHERE vt IN (0, 1) GROUP BY ALL),
c AS (SELECT cov.cf_id, cov.k, rs, bvt, greatest(coalesce(bs, 0), rs) AS cut, CASE WHEN bvt = 1 AND bs > rs THEN bv END AS base FROM cov LEFT JOIN b USING (cf_id, k)),
o AS (SELECT p.cf_id, p.k, {fold} AS ops FROM pt p JOIN c USING (cf_id, k) WHERE vt = 3 AND seq > cut GROUP BY ALL),
r AS (SELECT cf_id, k, {value} AS val FROM c LEFT JOIN o USING (cf_id, k) WHERE base IS NOT NULL OR ops IS NOT NULL)
"""


ALL = "SELECT cf_id, k AS key, val FROM r"
FLAGSHIP = resolved() + ALL
_KEYS = "('000003', '000007', '000011', '000042', '999999')"

ORDERS = """log AS (SELECT 0 AS cf_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k, o_orderkey * 100 AS seq, 1 AS vt, o_orderstatus AS v, NULL AS end_k FROM orders
  UNION ALL SELECT 0, lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_orderkey * 100 + l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END,
  CASE WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END, NULL
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2))"""

KEPT = f"""WITH {LOG},
m AS (SELECT *, row_number() OVER (PARTITION BY cf_id, k, vt IN (0, 1) ORDER BY seq DESC) AS nth FROM log)
SELECT cf_id, k AS key, seq, CAST(vt AS INTEGER) AS vt, v AS val, end_k AS end_key FROM m WHERE vt IN (2, 3) OR nth = 1"""

_PINS = (1500, 3000, 7777)
PINNED = f"""WITH {LOG},
m AS (SELECT *, lead(seq) OVER (PARTITION BY cf_id, k, vt IN (0, 1) ORDER BY seq) AS nx FROM log)
SELECT cf_id, k AS key, seq, CAST(vt AS INTEGER) AS vt FROM m WHERE vt IN (2, 3) OR nx IS NULL OR {" OR ".join(f"(seq <= {p} AND nx > {p})" for p in _PINS)}"""

#: A file catalog made of lineitem: a file for each 64 orders, its size from the prices.
FILES = """files AS (SELECT CAST(l_orderkey // 64 AS BIGINT) AS file_id, CAST(l_orderkey // 64 % 4 AS INTEGER) AS level,
  CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS file_size, min(l_partkey) AS lo, min(l_partkey) + 40 AS hi FROM lineitem GROUP BY 1, 2)"""

ORACLES = {
    "latest_full_scan": FLAGSHIP,
    "scan_as_of_snapshot": resolved(3000) + ALL,
    "scan_as_of_zero": resolved(0) + ALL,
    "scan_beyond_last": resolved(10**9) + ALL,
    "point_get": resolved() + ALL + " WHERE cf_id = 0 AND k = '000042'",
    "get_in_family": resolved() + ALL + " WHERE cf_id = 1 AND k = '000042'",
    "get_as_of": resolved(5000) + ALL + " WHERE cf_id = 0 AND k = '000042'",
    "multi_get": resolved() + f"SELECT t.cf_id, t.key, r.val FROM (SELECT unnest([0, 1]) AS cf_id, key FROM (SELECT unnest(['000003', '000007', '000011', '000042', '999999']) AS key)) t LEFT JOIN r ON r.cf_id = t.cf_id AND r.k = t.key",
    "range_scan_half_open": resolved() + ALL + " WHERE k >= '000020' AND k < '000060'",
    "range_scan_inclusive": resolved() + ALL + " WHERE k >= '000020' AND k <= '000060'",
    "range_scan_exclusive": resolved() + ALL + " WHERE k > '000020' AND k < '000060'",
    "range_scan_unbounded": resolved() + ALL + " WHERE k >= '000060'",
    "prefix_scan": resolved() + ALL + " WHERE starts_with(k, '00001')",
    "range_scan_as_of": resolved(4000) + ALL + " WHERE k >= '000020' AND k < '000060'",
    "reverse_top_keys": resolved() + ALL + " WHERE cf_id = 0 ORDER BY k DESC LIMIT 10",
    "cf_isolation_counts": resolved() + "SELECT cf_id, count(*) AS n FROM r GROUP BY 1",
    "list_column_families": "SELECT * FROM (VALUES (0, 'default'), (1, 'cf1')) t(cf_id, name)",
    "put_overwrite": f"WITH {LOG} SELECT cf_id, k AS key, arg_max(v, seq) AS val FROM log WHERE vt = 1 GROUP BY ALL",
    "delete_suppresses": f"WITH {LOG} SELECT cf_id, k AS key FROM log WHERE vt IN (0, 1) GROUP BY ALL HAVING arg_max(vt, seq) = 0",
    "delete_range_effect": resolved() + "SELECT cf_id, k AS key, rs AS cov FROM c LEFT JOIN o USING (cf_id, k) WHERE base IS NULL AND ops IS NULL AND bvt = 1",
    "delete_range_then_put": resolved() + "SELECT cf_id, k AS key, base AS val FROM c WHERE rs > 0 AND base IS NOT NULL",
    "covering_tombstone_seq": resolved() + "SELECT cf_id, k AS key, rs AS cov FROM cov",
    "merge_append": FLAGSHIP,
    "merge_sum": resolved(fold="CAST(sum(n) AS BIGINT)", value="CAST(coalesce(base, 0) + coalesce(ops, 0) AS VARCHAR)", v="n") + ALL,
    "merge_max": resolved(fold="max(v)", value="greatest(base, ops)") + ALL,
    "merge_min": resolved(fold="min(v)", value="least(base, ops)") + ALL,
    "merge_last": resolved(fold="arg_max(v, seq)", value="coalesce(ops, base)") + ALL,
    "merge_set_union": resolved(fold="list(v)", value="array_to_string(list_sort(list_distinct(list_filter(list_append(coalesce(ops, []), base), lambda x: x IS NOT NULL AND x <> ''))), ',')") + ALL,
    "merge_python": resolved(value="CAST(length(coalesce(base, '') || coalesce(ops, '')) AS VARCHAR)") + ALL,
    "merge_no_base": resolved() + "SELECT cf_id, k AS key, ops AS val FROM c JOIN o USING (cf_id, k) WHERE base IS NULL",
    "batch_atomic_sequence": "SELECT o_orderkey AS ord, 100 + row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders",
    "latest_seq_per_key": f"WITH {LOG} SELECT cf_id, k AS key, max(seq) AS seq FROM log GROUP BY ALL",
    "txn_conflicts": f"WITH {LOG}, t AS (SELECT DISTINCT cf_id, k FROM log WHERE seq <= 9000) SELECT t.cf_id, t.k AS key FROM t WHERE EXISTS (SELECT 1 FROM log l WHERE l.cf_id = t.cf_id AND l.seq > 9000 AND (l.k = t.k OR l.vt = 2 AND l.k <= t.k AND t.k < l.end_k))",
    "txn_conflicts_compat": f"WITH {LOG}, t AS (SELECT DISTINCT cf_id, k FROM log WHERE seq <= 9000) SELECT t.cf_id, t.k AS key FROM t WHERE EXISTS (SELECT 1 FROM log l WHERE l.cf_id = t.cf_id AND l.seq > 9000 AND l.k = t.k)",
    "txn_range_conflicts": f"""WITH {LOG}, t(cf_id, s, e) AS (VALUES (0, '000010', '000012'), (1, '000100', '000101'), (0, '900000', '900001'))
SELECT cf_id, s AS "start", e AS "end" FROM t WHERE EXISTS (SELECT 1 FROM log l WHERE l.cf_id = t.cf_id AND l.seq > 9900 AND CASE WHEN l.vt = 2 THEN t.s < l.end_k AND l.k < t.e ELSE l.k >= t.s AND l.k < t.e END)""",
    "compact_keep_rule": KEPT,
    "compact_keep_pinned": PINNED,
    "compact_preserves_resolve": FLAGSHIP,
    "compact_folds_operands": resolved() + ALL,
    "ttl_filter": "SELECT event_id AS seq, CASE WHEN CAST(epoch_us(ts) AS BIGINT) <= 1704500000000000 THEN 0 ELSE 1 END AS vt FROM events",
    "fifo_retention": f"WITH {FILES}, s AS (SELECT *, sum(file_size) OVER (ORDER BY file_id DESC) AS t FROM files) SELECT file_id, file_size FROM s WHERE t <= (SELECT sum(file_size) // 2 FROM files)",
    "level_sizes": f"WITH {FILES} SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS bytes FROM files GROUP BY level",
    "compaction_scores": f"WITH {FILES} SELECT level, CAST(sum(file_size) AS BIGINT) AS bytes, 4194304.0::DOUBLE * power(10, level - 1) AS target, sum(file_size) / (4194304.0::DOUBLE * power(10, level - 1)) AS score FROM files WHERE level BETWEEN 1 AND 2 GROUP BY level",
    "pick_level": f"WITH {FILES} SELECT level FROM files WHERE level BETWEEN 1 AND 2 GROUP BY level ORDER BY sum(file_size) / (4194304.0 * power(10, level - 1)) DESC LIMIT 1",
    "overlapping_files": f"""WITH RECURSIVE {FILES}, w(a, b) AS (SELECT min(lo), max(hi) FROM files WHERE level = 0
  UNION SELECT least(a, (SELECT min(lo) FROM files WHERE level = 1 AND hi >= a AND lo <= b)), greatest(b, (SELECT max(hi) FROM files WHERE level = 1 AND hi >= a AND lo <= b)) FROM w)
SELECT file_id FROM files WHERE level = 1 AND hi >= (SELECT min(a) FROM w) AND lo <= (SELECT max(b) FROM w)""",
    "universal_pick": f"""WITH RECURSIVE {FILES}, z AS (SELECT file_id, file_size, row_number() OVER (ORDER BY file_id) AS nth FROM files WHERE level = 0),
w(nth, total) AS (SELECT nth, file_size FROM z WHERE nth = 1
  UNION ALL SELECT z.nth, w.total + z.file_size FROM w JOIN z ON z.nth = w.nth + 1 WHERE z.nth <= 8 AND z.file_size <= greatest(1, w.total * 150 // 100))
SELECT file_id FROM z WHERE nth IN (SELECT nth FROM w) AND (SELECT count(*) FROM w) >= 2""",
    "store_versions_of_key": f"WITH {LOG} SELECT seq, CAST(vt AS INTEGER) AS vt, v AS val FROM log WHERE cf_id = 0 AND k = '000042' AND vt <> 2",
    "store_log_scan": f"WITH {LOG} SELECT cf_id, k AS key, seq, CAST(vt AS INTEGER) AS vt, v AS val, end_k AS end_key FROM log",
    "store_metrics": f"WITH {LOG} SELECT CASE WHEN vt IN (1, 3) THEN 'puts' ELSE 'deletes' END AS name, count(*) AS value FROM log GROUP BY 1 UNION ALL SELECT 'write_batches', 2",
    "store_levels": "SELECT * FROM (VALUES ('levels_apart', true), ('nothing_due', true), ('only_live_files', true)) t(name, holds)",
    "store_multi_get": resolved() + f"SELECT t.cf_id, t.key, r.val FROM (SELECT unnest([0, 1]) AS cf_id, key FROM (SELECT unnest([{_KEYS[1:-1]}]) AS key)) t LEFT JOIN r ON r.cf_id = t.cf_id AND r.k = t.key",
    "store_transaction": "SELECT * FROM (VALUES (0, '000003', 'committed'), (0, '000042', 'conflict'), (1, '000003', 'committed'), (1, '000042', 'conflict')) t(cf_id, key, outcome)",
    "store_operands_folded": FLAGSHIP,
    "store_properties": f"""WITH {LOG}, n AS (SELECT count(*) FILTER (vt IN (1, 3)) AS p, count(*) FILTER (vt NOT IN (1, 3)) AS d FROM log)
SELECT 'puts' AS name, CAST(p + 1 AS VARCHAR) AS value FROM n UNION ALL SELECT 'deletes', CAST(d AS VARCHAR) FROM n
UNION ALL SELECT * FROM (VALUES ('flushes', '1'), ('max_levels', '4'), ('l0_slowdown_trigger', '8'), ('flush', '1 records'), ('families', 'default,cf1'))""",
    "store_family_override": f"WITH {LOG} SELECT 1 AS cf_id, k AS key, arg_max(v, seq) AS val FROM log WHERE vt = 1 GROUP BY k",
    "store_get_as_of": resolved(5000) + "SELECT t.cf_id, t.key, r.val FROM (SELECT unnest([0, 1]) AS cf_id, key FROM (SELECT unnest(['000003', '000042', '000077']) AS key)) t LEFT JOIN r ON r.cf_id = t.cf_id AND r.k = t.key",
    "op_metrics": f"WITH {LOG} SELECT CASE WHEN vt IN (1, 3) THEN 'puts' ELSE 'deletes' END AS name, count(*) AS value FROM log GROUP BY 1",
    "write_bytes": f"WITH {LOG} SELECT cf_id, CAST(16 + sum(CASE vt WHEN 0 THEN 9 + length(k) WHEN 2 THEN 13 + length(k) + length(end_k) ELSE 13 + length(k) + length(v) END) AS BIGINT) AS bytes FROM log GROUP BY cf_id",
    "raw_log_scan": f"WITH {LOG} SELECT cf_id, k AS key, seq, CAST(vt AS INTEGER) AS vt, v AS val, end_k AS end_key FROM log",
    "versions_of_key": f"WITH {LOG} SELECT seq, CAST(vt AS INTEGER) AS vt, v AS val FROM log WHERE cf_id = 0 AND k = '000042' AND vt <> 2",
    "latest_record_of_key": f"WITH {LOG} SELECT cf_id, k AS key, CAST(arg_max(vt, seq) AS INTEGER) AS vt, arg_max(v, seq) AS val FROM log WHERE vt <> 2 AND seq <= 6000 GROUP BY ALL",
    "order_state": resolved(source=ORDERS) + "SELECT k AS key, val FROM r",
    "order_state_as_of": resolved(600_000, source=ORDERS) + "SELECT k AS key, val FROM r",
    "order_state_sql": resolved(source=ORDERS) + "SELECT val, count(*) AS n FROM r GROUP BY 1",
    "write_ops_roundtrip": FLAGSHIP,
    "flush_roundtrip": FLAGSHIP,
    "reopen_roundtrip": FLAGSHIP,
    "ingest_visible": FLAGSHIP,
    "checkpoint_roundtrip": FLAGSHIP,
    "repair_roundtrip": FLAGSHIP,
    "leveled_compaction_roundtrip": FLAGSHIP,
    "universal_compaction_roundtrip": FLAGSHIP,
    "stream_into_store": FLAGSHIP,
    "vacuum_candidates": f"WITH {FILES} SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM (SELECT file_id FROM files WHERE level > 0) l WHERE l.file_id = f.file_id)",
    "wide_values": "SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, arg_max(text, doc_id) AS val FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1",
    "prefix_successor": "SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN user_id % 10 < 9 THEN lpad(CAST(user_id + 1 AS VARCHAR), 6, '0') ELSE left(lpad(CAST(user_id AS VARCHAR), 6, '0'), 5) || ':' END AS next_key FROM events",
}
