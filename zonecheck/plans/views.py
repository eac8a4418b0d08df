"""Domain tables derived from the test tables, as SQL that Spark and DuckDB both run.

Coordinates are metres in a plane. A registered query starts from these views, its SQL counterpart has them in front.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "f_street": """
SELECT p_partkey AS street_id,
 CASE p_partkey % 6 WHEN 0 THEN 'Ulica ' || n WHEN 1 THEN n || '.' WHEN 2 THEN upper(n)
  WHEN 3 THEN n || ' ulica' WHEN 4 THEN replace(replace(n,'a','á'),'e','é') ELSE n END AS street
FROM (SELECT p_partkey, p_name || ' ' || lower(p_type) AS n FROM part) t
""",
    "f_district": """
SELECT s_suppkey AS district_id, CAST(floor(s_suppkey / 20) AS BIGINT) AS municipality_id, s_name AS name,
 CASE WHEN s_suppkey % 10 = 7 THEN NULL ELSE s_suppkey END AS school_id,
 CASE WHEN s_suppkey % 20 < 15 THEN 'ZS' ELSE 'MS' END AS school_type,
 CASE WHEN s_suppkey % 20 < 10 THEN 'SK' ELSE NULL END AS teaching_language,
 CASE s_suppkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE NULL END AS geometry_confidence,
 CAST(1000 * (s_suppkey % 10) AS DOUBLE) AS x0, CAST(1000 * floor(s_suppkey / 10) AS DOUBLE) AS y0,
 CAST(1000 * (s_suppkey % 10) + 900 + 100 * (s_suppkey % 4) AS DOUBLE) AS x1,
 CAST(1000 * floor(s_suppkey / 10) + 950 + 50 * (s_suppkey % 3) AS DOUBLE) AS y1
FROM supplier
""",
    "f_municipality": """
SELECT d.municipality_id, n.n_name AS name, n.n_regionkey AS region_id,
 CASE WHEN d.municipality_id % 5 = 0 THEN 'HU' ELSE NULL END AS minority_language
FROM (SELECT DISTINCT CAST(floor(s_suppkey / 20) AS BIGINT) AS municipality_id FROM supplier) d
JOIN nation n ON n.n_nationkey = d.municipality_id % 25
""",
    "f_school": """
SELECT s_suppkey AS school_id, CASE WHEN s_suppkey % 20 < 15 THEN 'ZS' ELSE 'MS' END AS type, s_acctbal > 1000 AS is_public,
 CAST(1000 * (s_suppkey % 10) + 37 * (s_suppkey % 31) + 0.5 AS DOUBLE) AS x,
 CAST(1000 * floor(s_suppkey / 10) + 29 * (s_suppkey % 37) + 0.5 AS DOUBLE) AS y FROM supplier
""",
    "f_address": """
SELECT o_orderkey AS address_id, CAST(floor(y / 2000) AS BIGINT) AS municipality_id, x, y FROM (
 SELECT o_orderkey, CAST(o_orderkey * 7919 % 10000 AS DOUBLE) + 0.25 AS x,
  CAST(o_orderkey * 104729 % (ns * 100) AS DOUBLE) + 0.25 AS y FROM orders CROSS JOIN (SELECT count(*) AS ns FROM supplier) c) t
""",
    "f_register": """
SELECT o_orderkey AS register_id, o_orderkey % nm AS municipality_id,
 s.street AS ulica, ' ' || CAST(o_orderkey % 41 AS VARCHAR(9)) AS supisne_cislo,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey % 60 + 1 AS VARCHAR(9)) || 'A ' ELSE CAST(o_custkey % 60 + 1 AS VARCHAR(9)) END AS orientacne_cislo,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN false ELSE true END AS obyvatelna,
 o_orderpriority = '1-URGENT' AS vyradena
FROM orders CROSS JOIN (SELECT count(*) AS np FROM part) a CROSS JOIN (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) AS nm FROM supplier) b
JOIN f_street s ON s.street_id = o_orderkey % np
""",
    "f_street_range": """
SELECT DISTINCT l_suppkey AS district_id, s.street,
 CASE l_orderkey % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'odd' WHEN 2 THEN 'even' WHEN 3 THEN 'range' ELSE 'single' END AS range_type,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS lo,
 CASE WHEN l_orderkey % 5 IN (1,2,3) THEN CAST(l_quantity AS INT) + 20 ELSE NULL END AS hi
FROM lineitem JOIN f_street s ON s.street_id = l_partkey
""",
    "f_house_geocode": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS district_id, s.street,
 CASE WHEN l_orderkey % 19 = 0 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END AS house_number,
 CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'ZERO_RESULTS' ELSE 'OK' END AS status,
 l_linestatus = 'O' AS partial_match,
 CASE l_orderkey % 4 WHEN 0 THEN s.street || ', 080 01 Mesto, Slovakia'
  WHEN 1 THEN s.street || ' ' || CAST(CAST(l_quantity AS INT) + 1 AS VARCHAR(9)) || ', 080 01 Mesto, Slovakia'
  WHEN 2 THEN s.street || ' ' || CAST(l_partkey AS VARCHAR(9)) || '/' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || ', Cast, 080 01 Mesto, Slovakia'
  ELSE s.street || ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || ', 080 01 Mesto, Slovakia' END AS formatted_address
FROM lineitem JOIN f_street s ON s.street_id = l_partkey
""",
    "f_verdict": """
SELECT event_id AS verdict_id, user_id % ns AS district_id,
 CASE event_id % 9 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' WHEN 2 THEN 'S3' WHEN 3 THEN 'Pa' WHEN 4 THEN 'Pb' WHEN 5 THEN 'Pc' WHEN 6 THEN 'Pd' WHEN 7 THEN 'Pe' ELSE 'Pf' END AS condition_code,
 CASE WHEN event_id % 9 < 3 THEN CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'view' THEN 'INCOMPLETE' ELSE 'PASS' END
  WHEN event_id % 9 < 7 THEN CASE event_type WHEN 'error' THEN 'RISK' WHEN 'view' THEN 'INSUFFICIENT_DATA' WHEN 'click' THEN 'FAIL' ELSE 'PASS' END
  ELSE CASE event_type WHEN 'error' THEN 'SIGNAL' WHEN 'view' THEN 'NOT_EVALUATED' ELSE 'NO_SIGNAL' END END AS value,
 event_id % 9 = 5 AND event_id % 2 = 0 AS is_illustrative, floor(value * 2) / 1000 AS confidence, ts AS computed_at,
 'v' || CAST(event_id % 3 AS VARCHAR(9)) AS engine_version, p.url AS source, d.text AS evidence_text
FROM events CROSS JOIN (SELECT count(*) AS np FROM pages) a CROSS JOIN (SELECT count(*) AS nd FROM documents) b
 CROSS JOIN (SELECT count(*) AS ns FROM supplier) c
JOIN pages p ON p.page_id = event_id % np JOIN documents d ON d.doc_id = event_id % nd
""",
    "f_finding": """
SELECT verdict_id AS finding_id, verdict_id, district_id, condition_code,
 CASE value WHEN 'FAIL' THEN 'critical' WHEN 'RISK' THEN 'high' WHEN 'INCOMPLETE' THEN 'medium' WHEN 'SIGNAL' THEN 'medium' WHEN 'INSUFFICIENT_DATA' THEN 'low' ELSE 'info' END AS severity,
 CASE verdict_id % 4 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'resolved' ELSE 'open' END AS status,
 evidence_text, computed_at AS created_at, verdict_id % 50 = 0 AS is_demo FROM f_verdict WHERE value <> 'PASS'
""",
    "f_route": """
SELECT l_orderkey AS origin_id, l_linenumber AS origin_no, l_suppkey AS district_id,
 CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE round(l_extendedprice / 16, 1) END AS distance_m,
 CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_quantity * 60 END AS duration_s FROM lineitem
""",
    "f_seed": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS district_id, CAST(floor(l_suppkey / 20) AS BIGINT) AS municipality_id,
 CAST(1000 * (l_suppkey % 10) + (l_orderkey * 37 + l_partkey * 11) % 1400 AS DOUBLE) AS x,
 CAST(1000 * floor(l_suppkey / 10) + (l_orderkey * 53 + l_partkey * 7) % 1400 AS DOUBLE) AS y FROM lineitem
""",
    "f_outline": """
SELECT b.municipality_id, c.ring, c.seq, b.x0 + (b.x1 - b.x0) * CAST(c.fx AS DOUBLE) AS x, b.y0 + (b.y1 - b.y0) * CAST(c.fy AS DOUBLE) AS y
FROM (SELECT municipality_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f_district GROUP BY municipality_id) b
CROSS JOIN (VALUES (0, 0, 0.02, 0.03), (0, 1, 0.55, 0.1), (0, 2, 0.97, 0.02), (0, 3, 0.9, 0.45), (0, 4, 0.98, 0.95), (0, 5, 0.6, 0.8), (0, 6, 0.35, 0.97), (0, 7, 0.05, 0.9), (0, 8, 0.2, 0.5), (0, 9, 0.02, 0.03),
 (1, 0, 0.4, 0.35), (1, 1, 0.45, 0.6), (1, 2, 0.65, 0.55), (1, 3, 0.6, 0.3), (1, 4, 0.4, 0.35)) AS c(ring, seq, fx, fy)
""",
    "f_line": """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(9)) || ':' || CAST(l_partkey AS VARCHAR(20)) || ':' || CAST(district_id AS VARCHAR(20)) AS line_id, district_id, municipality_id, x AS ax, y AS ay,
 x + 300 + 50 * (l_partkey % 7) AS bx, y + 90 * (l_orderkey % 5) - 175 AS bz FROM f_seed
""",
}


def needed(sql: str) -> list[str]:
    """The views that ``sql`` names, those that they need first."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in [*needed(VIEWS[name]), name] if x not in found]
    return found


def with_views(sql: str) -> str:
    """``sql``, which may begin with WITH, with the views it names in front."""
    views = needed(sql)
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    rest = sql.strip()
    recursive = re.match(r"(?i)with\s+recursive\s+", rest)
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{rest[recursive.end():]}"
    own = re.match(r"(?i)with\s+", rest)
    return f"WITH {ctes},\n{rest[own.end():]}" if own else f"WITH {ctes}\n{rest}"


class Views:
    """The tables of one folder: ``views("f_address")`` and ``views("orders")`` are DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str) -> DataFrame:
        """A table whose rows the views join to long texts; of a file of fewer splits than cores the rows, still narrow, are dealt out first."""
        rows, cores = self.table(name), self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

    def sql(self, sql: str) -> DataFrame:
        text = with_views(sql)
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                (self.dealt if name == "events" and "f_verdict" in text else self.table)(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __call__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}") if name in VIEWS else self.table(name)
