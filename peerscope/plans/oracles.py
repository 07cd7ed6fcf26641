"""DuckDB SQL for the query catalogue, over the driver's tables. Views in braces are put in front."""

from __future__ import annotations

from peerscope.operators.layout import DRAWS, FACTORS, GRID_SIDE
from peerscope.plans.queries import BOX, IP_RANGE, NEIGHBOURS, TOP, TREE, WEEK
from peerscope.sources.views import with_views

N = "count(*) AS n"
FROM_AS = "LEFT JOIN {as_ranges} a ON f.intipfrom BETWEEN a.ip_start AND a.ip_end"
TO_AS = "LEFT JOIN {as_ranges} b ON f.intipto BETWEEN b.ip_start AND b.ip_end"
FROM_DNS, TO_DNS = "LEFT JOIN {dns} a ON f.intipfrom = a.intip", "LEFT JOIN {dns} b ON f.intipto = b.intip"
NAMES = "coalesce(a.{0}, 'null') || ' ' || coalesce(b.{0}, 'null') AS names"
IN_WEEK = f"f.flow_date BETWEEN DATE '{WEEK[0]}' AND DATE '{WEEK[1]}'"

IN_BOX = f"""f.intipfrom BETWEEN {BOX.low['intipfrom']} AND {BOX.high['intipfrom']} AND f.intipto <= {BOX.high['intipto']}
  AND f.flow_date BETWEEN DATE '{BOX.low['flow_date']}' AND DATE '{BOX.high['flow_date']}'"""
DRAW = f"(intipfrom % {DRAWS} * {FACTORS[0]} + intipto % {DRAWS} * {FACTORS[1]} + date_diff('day', DATE '1970-01-01', flow_date) % {DRAWS} * {FACTORS[2]}) % {DRAWS}"


def case(node: int = 1) -> str:
    """The literal tree as nested CASE."""
    if node not in TREE.splits:
        return str(node)
    dim, value = TREE.splits[node]
    column = ("f.intipfrom", "f.intipto", "epoch_ms(CAST(f.flow_date AS TIMESTAMP))")[dim]
    return f"CASE WHEN {column} > {value:.0f} THEN {case(2 * node)} ELSE {case(2 * node + 1)} END"


LEAF = f"CAST({case()} AS BIGINT)"
LEAVES = TREE.leaves()
RANK = "CASE " + " ".join(f"WHEN part = {x} THEN {k}" for k, x in enumerate(LEAVES)) + " END"
POINTS = f"(SELECT list((k + 1) * 4294967296 // {GRID_SIDE}) AS points FROM range({GRID_SIDE - 1}) t(k)) g"
INDEX = "len(list_filter(g.points, lambda p: p < {}))"
CELL = f"CAST({INDEX.format('least(f.intipfrom, f.intipto)')} * {GRID_SIDE} + {INDEX.format('greatest(f.intipfrom, f.intipto)')} AS BIGINT)"
PAD = " || '.' || ".join(f"lpad(split_part({{0}}, '.', {k}), 3, '0')" for k in range(1, 5))
QUAD = " || '.' || ".join(f"CAST(({{0}} >> {k}) & 255 AS VARCHAR)" for k in (24, 16, 8, 0))
ADDRESSES = """
CAST(sum(ip_end - ip_start + 1) AS BIGINT) AS n, min(ip_start) AS low, max(ip_end) AS high,
CAST(sum(CAST(ip_start + ip_end AS HUGEINT) * (ip_end - ip_start + 1) // 2) AS BIGINT) AS total"""

RAW = {
    "as_ingoing": f"SELECT b.as_name, {N} FROM {{flows}} f {TO_AS} GROUP BY 1",
    "as_outgoing": f"SELECT a.as_name, {N} FROM {{flows}} f {FROM_AS} GROUP BY 1",
    "as_ingoing_inner": f"SELECT b.as_name, {N} FROM {{flows}} f {TO_AS[5:]} GROUP BY 1",
    "as_pairs": f"SELECT a.as_name AS src_as_name, b.as_name AS dst_as_name, {N} FROM {{flows}} f {FROM_AS} {TO_AS} GROUP BY 1, 2",
    "as_pairs_inner": f"SELECT a.as_name AS src_as_name, b.as_name AS dst_as_name, {N} FROM {{flows}} f {FROM_AS[5:]} {TO_AS[5:]} GROUP BY 1, 2",
    "country_outgoing": f"""
SELECT c.country_code || '_' || c.country_name AS country, {N}
FROM {{flows}} f LEFT JOIN {{country_ranges}} c ON f.intipfrom BETWEEN c.ip_start AND c.ip_end GROUP BY 1""",
    "country_pairs": f"""
SELECT a.country_code || '_' || a.country_name AS src_country, b.country_code || '_' || b.country_name AS dst_country, {N}
FROM {{flows}} f LEFT JOIN {{country_ranges}} a ON f.intipfrom BETWEEN a.ip_start AND a.ip_end
LEFT JOIN {{country_ranges}} b ON f.intipto BETWEEN b.ip_start AND b.ip_end GROUP BY 1, 2""",
    "city_outgoing": f"""
SELECT l.city, {N} FROM {{flows}} f JOIN {{city_blocks}} c ON f.intipfrom BETWEEN c.ip_start AND c.ip_end
JOIN {{locations}} l ON c.loc_id = l.loc_id GROUP BY 1""",
    "city_outgoing_left": f"""
SELECT l.city, {N} FROM {{flows}} f LEFT JOIN {{city_blocks}} c ON f.intipfrom BETWEEN c.ip_start AND c.ip_end
LEFT JOIN {{locations}} l ON c.loc_id = l.loc_id GROUP BY 1""",
    "dns_ingoing_left": f"SELECT f.ipto, b.dnsname, {N} FROM {{flows}} f {TO_DNS} GROUP BY 1, 2",
    "dns_ingoing_grid": f"SELECT f.ipto, b.dnsname, {N} FROM {{flows}} f {TO_DNS} GROUP BY 1, 2",
    "dns_ingoing_tree": f"""
WITH tagged AS (SELECT {LEAF} AS part, f.ipto, f.intipto FROM {{flows}} f)
SELECT CAST({RANK} AS INT) AS part, f.ipto, b.dnsname, {N} FROM tagged f {TO_DNS} GROUP BY 1, 2, 3""",
    "dns_ingoing_week": f"SELECT f.ipto, b.dnsname, {N} FROM {{flows}} f {TO_DNS} WHERE {IN_WEEK} GROUP BY 1, 2",
    "dns_pairs_inner": f"SELECT a.dnsname AS src_name, b.dnsname AS dst_name, {N} FROM {{flows}} f {FROM_DNS[5:]} {TO_DNS[5:]} GROUP BY 1, 2",
    "dns_pairs_left": f"SELECT a.dnsname AS src_name, b.dnsname AS dst_name, {N} FROM {{flows}} f {FROM_DNS} {TO_DNS} GROUP BY 1, 2",
    "dns_pairs_concat": f"SELECT {NAMES.format('dnsname')}, {N} FROM {{flows}} f {FROM_DNS} {TO_DNS} GROUP BY 1",
    "dns_pairs_tree": f"SELECT {LEAF} AS part, {NAMES.format('dnsname')}, {N} FROM {{flows}} f {FROM_DNS} {TO_DNS} GROUP BY 1, 2",
    "server_class": f"""
SELECT CASE WHEN ipfrom IN (SELECT ip FROM {{servers}}) AND ipto IN (SELECT ip FROM {{servers}}) THEN 'DARK'
            WHEN ipto IN (SELECT ip FROM {{servers}}) THEN 'RX_SRV' WHEN ipfrom IN (SELECT ip FROM {{servers}}) THEN 'TX_SRV' ELSE 'UNK_S2S' END AS server_class, {N}
FROM {{flows}} GROUP BY 1""",
    "as_ingoing_monthly": f"""
SELECT b.as_name, {N} FROM {{flows}} f
LEFT JOIN {{as_ranges_monthly}} b ON b.mon = month(f.flow_date) AND f.intipto BETWEEN b.ip_start AND b.ip_end GROUP BY 1""",
    "as_pairs_monthly_concat": f"""
SELECT {NAMES.format('as_name')}, {N} FROM {{flows}} f
LEFT JOIN {{as_ranges_monthly}} a ON a.mon = month(f.flow_date) AND f.intipfrom BETWEEN a.ip_start AND a.ip_end
LEFT JOIN {{as_ranges_monthly}} b ON b.mon = month(f.flow_date) AND f.intipto BETWEEN b.ip_start AND b.ip_end GROUP BY 1""",
    "dns_ingoing_monthly": f"""
SELECT f.ipto, b.dnsname, {N} FROM {{flows}} f LEFT JOIN {{dns_monthly}} b ON f.intipto = b.intip AND b.mon = month(f.flow_date) GROUP BY 1, 2""",
    "dns_pairs_monthly": f"""
SELECT {NAMES.format('dnsname')}, {N} FROM {{flows}} f
LEFT JOIN {{dns_monthly}} a ON f.intipfrom = a.intip AND a.mon = month(f.flow_date)
LEFT JOIN {{dns_monthly}} b ON f.intipto = b.intip AND b.mon = month(f.flow_date) GROUP BY 1""",
    "topk_as_pairs_week": f"""
SELECT a.as_name AS src_as_name, b.as_name AS dst_as_name, {N} FROM {{flows}} f {FROM_AS} {TO_AS} WHERE {IN_WEEK}
GROUP BY 1, 2 ORDER BY n DESC, src_as_name NULLS FIRST, dst_as_name NULLS FIRST LIMIT {TOP}""",
    "topk_dns_bytes": f"""
SELECT a.dnsname, CAST(sum(f.ipsize) AS BIGINT) AS bytes FROM {{flows}} f {FROM_DNS[5:]} GROUP BY 1 ORDER BY bytes DESC, dnsname LIMIT {TOP}""",
    "daily_server_traffic": f"""
SELECT flow_date, {N}, CAST(sum(ipsize) AS BIGINT) AS bytes FROM {{flows}} WHERE ipto IN (SELECT ip FROM {{servers}}) GROUP BY 1""",
    "grid_assign": f"SELECT {CELL} AS cell, {N} FROM {{flows}} f, {POINTS} GROUP BY 1",
    "unique_ips_per_cell": f"""
WITH sides AS (SELECT {CELL} AS cell, unnest([f.ipfrom, f.ipto]) AS ip FROM {{flows}} f, {POINTS})
SELECT DISTINCT cell, {PAD.format('ip')} AS padded FROM sides""",
    "kd_assign": f"WITH tagged AS (SELECT {LEAF} AS part FROM {{flows}} f) SELECT part, {N}, CAST({RANK} AS INT) AS rank FROM tagged GROUP BY 1",
    "unique_ips_per_leaf": f"SELECT DISTINCT {LEAF} AS part, unnest([f.intipfrom, f.intipto]) AS intip FROM {{flows}} f",
    "unique_ip_lists": f"""
WITH sides AS (SELECT DISTINCT {LEAF} AS part, unnest([f.intipfrom, f.intipto]) AS intip FROM {{flows}} f)
SELECT part, {N}, min(intip) AS low, max(intip) AS high, CAST(0 AS BIGINT) AS out_of_order FROM sides GROUP BY 1""",
    "kd_built_scan": f"SELECT f.flow_date, {N}, CAST(sum(f.ipsize) AS BIGINT) AS bytes FROM {{flows}} f WHERE {IN_BOX} GROUP BY 1",
    "kd_built_leaves": f"SELECT protocol, {N}, count(*) AS inside, true AS many FROM {{flows}} GROUP BY 1",
    "replaced_partitions": f"""
SELECT protocol AS part, {N}, CAST(sum(CASE WHEN protocol = 17 THEN 2 * ipsize ELSE ipsize END) AS BIGINT) AS bytes FROM {{flows}} GROUP BY 1""",
    "loaded_flows": f"""
SELECT protocol, dstport, {N}, CAST(sum(ipsize) AS BIGINT) AS bytes, min(ipto) AS low, max(flow_date) AS latest FROM {{flows}} GROUP BY 1, 2""",
    "loaded_dimensions": """
SELECT 'as' AS kind, ip_start AS low, ip_end AS high, as_name || ' Ex_ample, Inc' AS name FROM {as_ranges}
UNION ALL SELECT 'country', ip_start, ip_end, country_code || ' ' || country_name FROM {country_ranges}
UNION ALL SELECT 'dns', intip, intip, dnsname FROM {dns}
UNION ALL SELECT 'server', intip, intip, 'srv' FROM {servers}""",
    "loaded_monthly_ranges": "SELECT ip_start, ip_end, mon, as_name FROM {as_ranges_monthly}",
    "tsv_totals": f"SELECT f.ipto, b.dnsname, {N} FROM {{flows}} f {TO_DNS} GROUP BY 1, 2",
    "dns_range": f"SELECT intip, dnsname FROM {{dns}} WHERE intip BETWEEN {IP_RANGE[0]} AND {IP_RANGE[1]}",
    "kd_pruned_scan": f"""
SELECT f.intipfrom, f.intipto, f.flow_date, f.ipsize, {LEAF} AS part FROM {{flows}} f
WHERE {IN_BOX}""",
    "partitioned_table": f"SELECT {LEAF} AS part, {N}, CAST(sum(f.ipsize) AS BIGINT) AS bytes FROM {{flows}} f GROUP BY 1",
    "ip_functions": f"""
SELECT DISTINCT ipto, intipto AS number, {PAD.format('ipto')} AS padded, {QUAD.format('intipto')} AS back, true AS valid FROM {{flows}}""",
    "as_range_explode": "SELECT unnest(range(ip_start, ip_end + 1)) AS ip, as_name FROM {small_as_ranges}",
    "country_range_explode": "SELECT unnest(range(ip_start, ip_end + 1)) AS ip, country_code, country_name FROM {small_country_ranges}",
    "as_range_addresses": f"SELECT as_name, {ADDRESSES} FROM {{as_ranges}} GROUP BY 1",
    "country_range_addresses": f"SELECT country_code, country_name, {ADDRESSES} FROM {{country_ranges}} GROUP BY 1, 2",
    "city_names": "SELECT loc_id, 'R' || CAST(n_regionkey AS VARCHAR) AS country_code, city FROM {locations}",
    "knn_embeddings": f"""
WITH wide AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, p.vec_id AS neighbour_id,
         list_sum(list_transform(list_zip(q.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
  FROM wide q, wide p WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, round(distance, 4) AS distance FROM ranked WHERE rank <= {NEIGHBOURS}""",
    "hash_sample": f"""
SELECT protocol, dstport, {N}, min(intipto) AS low, max(intipto) AS high FROM {{flows}} WHERE {DRAW} < {DRAWS // 20} GROUP BY 1, 2""",
    "stream_leaf_counts": f"SELECT {LEAF} AS part, {N}, CAST(sum(f.ipsize) AS BIGINT) AS bytes FROM {{flows}} f GROUP BY 1",
    "stream_split_totals": f"""
SELECT CAST(year(flow_date) AS INT) AS year, {N}, CAST(sum(ipsize) AS BIGINT) AS bytes, true AS split, true AS within, true AS routed FROM {{flows}} GROUP BY 1""",
    "stream_event_windows": f"""
SELECT date_trunc('hour', ts) AS hour, event_type, {N}, round(sum(value), 4) AS total FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
    "stream_marked": f"SELECT event_type || '!' AS marked, {N} FROM events GROUP BY 1",
}

ORACLE_SQL = {name: with_views(sql) for name, sql in RAW.items()}
