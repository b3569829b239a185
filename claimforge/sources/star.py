"""A knowledge graph over the star tables: nodes, edges, content facts and claims, defined once for Spark and DuckDB.

The texts below are plain SELECTs that both engines read; table names are filled in. Orders are arithmetic keys, so
none of them needs a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """
SELECT 'R' || CAST(r_regionkey AS STRING) AS id, r_name AS label, CAST(NULL AS STRING) AS description, CAST(NULL AS INT) AS sitelinks, 0 + CAST(r_regionkey AS BIGINT) AS node_ord FROM {region}
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'Nation ' || chr(65 + n_nationkey % 26) || 'land', CAST(NULL AS STRING), CAST(NULL AS INT), 1000000000000 + CAST(n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), c_name, 'a customer in ' || lower(c_mktsegment), CAST(NULL AS INT), 2000000000000 + c_custkey FROM {customer}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), s_name, CAST(NULL AS STRING), CAST(NULL AS INT), 3000000000000 + s_suppkey FROM {supplier}
UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 'Part ' || CAST(p_partkey AS STRING), p_name, p_size, 4000000000000 + p_partkey FROM {part}
UNION ALL SELECT 'O' || CAST(o_orderkey AS STRING), 'Order ' || CAST(o_orderkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS INT), 5000000000000 + o_orderkey FROM {orders}
"""

EDGES = """
SELECT 0 + CAST(n_nationkey AS BIGINT) AS edge_ord, 'N' || CAST(n_nationkey AS STRING) AS subject_id, 'PR' AS property_id, 'in region' AS property_label, 'R' || CAST(n_regionkey AS STRING) AS object_id, r_name AS object_label, 'item' AS value_type FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 1000000000000 + c_custkey, 'C' || CAST(c_custkey AS STRING), 'PN', 'nation', 'N' || CAST(c_nationkey AS STRING), 'Nation ' || chr(65 + c_nationkey % 26) || 'land', 'item' FROM {customer}
UNION ALL SELECT 2000000000000 + s_suppkey, 'S' || CAST(s_suppkey AS STRING), 'PN', 'nation', 'N' || CAST(s_nationkey AS STRING), 'Nation ' || chr(65 + s_nationkey % 26) || 'land', 'item' FROM {supplier}
UNION ALL SELECT 3000000000000 + o_orderkey, 'O' || CAST(o_orderkey AS STRING), 'PC', 'placed by', 'C' || CAST(o_custkey AS STRING), c_name, 'item' FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 4000000000000 + l_orderkey * 100 + l_linenumber, 'O' || CAST(l_orderkey AS STRING), 'PP', 'contains', 'P' || CAST(l_partkey AS STRING), 'Part ' || CAST(l_partkey AS STRING), 'item' FROM {lineitem}
UNION ALL SELECT 5000000000000 + l_orderkey * 100 + l_linenumber, 'S' || CAST(l_suppkey AS STRING), 'PS', 'supplies', 'P' || CAST(l_partkey AS STRING), 'Part ' || CAST(l_partkey AS STRING), 'item' FROM {lineitem}
UNION ALL SELECT 6000000000000 + p_partkey, 'P' || CAST(p_partkey AS STRING), 'PB', 'brand', CAST(NULL AS STRING), p_brand, 'string' FROM {part}
UNION ALL SELECT 7000000000000 + p_partkey, 'P' || CAST(p_partkey AS STRING), 'PZ', 'size', CAST(NULL AS STRING), CAST(p_size AS STRING), 'quantity' FROM {part}
UNION ALL SELECT 8000000000000 + c_custkey, 'C' || CAST(c_custkey AS STRING), 'PM', 'segment', CAST(NULL AS STRING), c_mktsegment, 'string' FROM {customer}
"""

#: Content facts of suppliers.
FACTS = """
SELECT 'S' || CAST(s_suppkey AS STRING) AS entity_id, 'text' AS modality, s_name || ' keeps a ledger of class ' || CAST(1000 + CAST(floor(abs(s_acctbal) / 100) AS INT) AS STRING) AS fact, 'ledger' AS source, s_suppkey AS label_ord FROM {supplier}
"""

#: Five claims of each supplier: its nation (each fifth one a wrong nation), its ledger, a two-step claim, one that names
#: it by a part of its label only, so that the head alone links to it, and one that nothing supports.
CLAIMS = """
SELECT 'S' || CAST(s_suppkey AS STRING) || '-nation' AS claim_id, s_name || ' nation Nation ' || chr(65 + (s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END) % 25) || 'land' AS text FROM {supplier}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || '-ledger', s_name || ' keeps a ledger of class ' || CAST(1000 + CAST(floor(abs(s_acctbal) / 100) AS INT) AS STRING) FROM {supplier}
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || '-region', s_name || ' nation Nation ' || chr(65 + s_nationkey % 26) || 'land, Nation ' || chr(65 + s_nationkey % 26) || 'land in region ' || r_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || '-alias', substr(s_name, 2) || ' is in nation Nation ' || chr(65 + s_nationkey % 26) || 'land, Nation ' || chr(65 + s_nationkey % 26) || 'land in region ' || r_name || ' supplier' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING) || '-none', s_name || ' was founded in ' || CAST(1900 + s_suppkey % 100 AS STRING) FROM {supplier}
"""

#: Claim outcomes of runs: a run is a user, a claim an event.
RUN_CLAIMS = """
SELECT 'u' || CAST(user_id AS STRING) AS run_id, event_id AS claim_id, CASE WHEN event_type IN ('view', 'purchase') THEN 'retrieved' WHEN event_type = 'click' THEN 'reasoned-supportable' ELSE 'fabricated' END AS status, props AS item, CASE user_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'knowledge-absent' ELSE 'content-absent' END AS condition, value FROM {events}
"""

#: Gold outcomes: labelled documents with an expected and a produced status, a score, a modality and a fold.
GOLD = """
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'retrieved' ELSE 'fabricated' END AS expected, least(CAST(1.0 AS DOUBLE), CAST(d.n_chars AS DOUBLE) / CAST(4000.0 AS DOUBLE)) AS score, d.lang AS modality, l.toxic = 1 AS adversarial, CASE WHEN d.doc_id % 2 = 0 THEN 'calibration' ELSE 'sweep' END AS fold FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

TABLES = "region nation customer supplier part orders lineitem events documents labels conversations benchmark".split()


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the views above over the tables of a folder."""
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def sql(text: str) -> str:
    """The same view as DuckDB reads it."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
