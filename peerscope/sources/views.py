"""The flow fact and its dimensions, derived from the driver's tables.

Each view is one SQL statement that Spark and DuckDB both run, but for the generator of months. Names in braces are
other tables or views. None joins without keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _quad(number: str) -> str:
    """A dotted quad by shifts, which both engines have."""
    return " || '.' || ".join(f"CAST((({number}) >> {k}) & 255 AS VARCHAR(3))" for k in (24, 16, 8, 0))


#: One row for each month; the engines spell it differently.
MONTHS, DUCKDB_MONTHS = "explode(sequence(1, 12))", "CAST(unnest(generate_series(1, 12)) AS INT)"

SOURCE_IP, TARGET_IP = "(l_suppkey * 2654435761) % 4294967296", "(l_partkey * 2654435811) % 4294967296"
SUPPLIER_IP, PART_IP = "(s_suppkey * 2654435761) % 4294967296", "(p_partkey * 2654435811) % 4294967296"

VIEWS = {
    "flows": f"""
SELECT {_quad("intipfrom")} AS ipfrom, intipfrom, {_quad("intipto")} AS ipto, intipto, protocol, srcport, dstport, ipsize, flow_date
FROM (SELECT {SOURCE_IP} AS intipfrom, {TARGET_IP} AS intipto,
             CASE WHEN l_linenumber % 3 = 0 THEN 17 ELSE 6 END AS protocol,
             CAST(1024 + l_orderkey % 60000 AS INT) AS srcport,
             CASE WHEN l_returnflag = 'R' THEN 443 WHEN l_returnflag = 'A' THEN 80 ELSE 53 END AS dstport,
             CAST(l_quantity * 10 AS BIGINT) AS ipsize, CAST(l_shipdate AS DATE) AS flow_date
      FROM {{lineitem}}) f""",
    "as_ranges": """
SELECT s_suppkey * w AS ip_start,
       CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey * w ELSE s_suppkey * w + CAST(floor(w * 0.75) AS BIGINT) - 1 END AS ip_end,
       'AS' || CAST(64512 + s_nationkey AS VARCHAR(8)) AS as_name
FROM (SELECT s_suppkey, s_nationkey, (SELECT CAST(floor(4294967296.0 / (max(s_suppkey) + 1)) AS BIGINT) FROM {supplier}) AS w FROM {supplier}) q""",
    "as_ranges_monthly": f"""
SELECT ip_start, ip_end, mon, as_name || '-' || CAST(mon % 3 AS VARCHAR(2)) AS as_name
FROM (SELECT ip_start, ip_end, as_name, {MONTHS} AS mon FROM {{as_ranges}}) m""",
    "country_ranges": """
SELECT n_nationkey * CAST(171798691 AS BIGINT) AS ip_start, n_nationkey * CAST(171798691 AS BIGINT) + 154618821 AS ip_end,
       'C' || CAST(n_nationkey AS VARCHAR(3)) AS country_code, n_name AS country_name FROM {nation}""",
    "small_as_ranges": """
SELECT p_partkey * 65536 AS ip_start, p_partkey * 65536 + p_size - 1 AS ip_end, 'AS' || CAST(64512 + p_partkey % 1000 AS VARCHAR(8)) AS as_name FROM {part}""",
    "small_country_ranges": """
SELECT n_nationkey * CAST(16777216 AS BIGINT) AS ip_start, n_nationkey * CAST(16777216 AS BIGINT) + n_nationkey * 100 AS ip_end,
       'C' || CAST(n_nationkey AS VARCHAR(3)) AS country_code, n_name AS country_name FROM {nation}""",
    "city_blocks": """
SELECT n_nationkey * CAST(171798691 AS BIGINT) AS ip_start, n_nationkey * CAST(171798691 AS BIGINT) + 100000000 AS ip_end,
       n_nationkey + 1 AS loc_id FROM {nation}""",
    "locations": "SELECT n_nationkey + 1 AS loc_id, 'City of ' || n_name AS city, n_regionkey FROM {nation}",
    "dns": f"""
SELECT {_quad("intip")} AS ip, intip, dnsname FROM (
  SELECT {PART_IP} AS intip, 'host' || CAST(p_partkey AS VARCHAR(12)) || '.' || lower(replace(p_brand, '#', '')) || '.example' AS dnsname
  FROM {{part}} WHERE p_partkey % 5 <> 0 AND p_partkey <> 0
  UNION ALL
  SELECT {SUPPLIER_IP}, 'gw' || CAST(s_suppkey AS VARCHAR(12)) || '.example' FROM {{supplier}} WHERE s_suppkey % 7 <> 0) x""",
    "dns_monthly": f"""
SELECT intip, mon, 'm' || CAST(mon % 3 AS VARCHAR(2)) || '.' || dnsname AS dnsname
FROM (SELECT intip, dnsname, {MONTHS} AS mon FROM {{dns}}) m""",
    "servers": f"""
SELECT {_quad("intip")} AS ip, intip FROM (
  SELECT {SUPPLIER_IP} AS intip FROM {{supplier}} WHERE s_suppkey % 10 = 3
  UNION SELECT {PART_IP} FROM {{part}} WHERE p_partkey % 10 = 3) x""",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{(\w+)}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a driver's table over the files of ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in names_in(VIEWS[name])})


def with_views(sql: str) -> str:
    """DuckDB SQL that defines the views named in braces in front of ``sql``."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in names_in(text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    plain = lambda text: re.sub(r"{(\w+)}", r"\1", text).replace(MONTHS, DUCKDB_MONTHS)
    views = ",\n".join(f"{name} AS ({plain(VIEWS[name])})" for name in order)
    body = plain(sql).strip()
    if not views:
        return body
    return f"WITH {views}{',' + body[4:] if body.upper().startswith('WITH ') else chr(10) + body}"
