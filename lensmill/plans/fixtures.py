"""Deterministic projections of the driver's tables: scanner inputs as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORNER_SQL = {
    "tl_x": "100 + CASE WHEN event_id % 41 = 0 THEN 300 WHEN event_id % 41 = 1 THEN -110 ELSE 0 END + CASE event_id % 43 WHEN 0 THEN -350 WHEN 1 THEN 170 ELSE 0 END",
    "tl_y": "100 + CASE WHEN event_id % 41 = 0 THEN 200 WHEN event_id % 41 = 1 THEN -110 ELSE 0 END - CASE WHEN event_id % 47 = 0 THEN 70 ELSE 0 END",
    "tr_x": "900 + CASE WHEN event_id % 41 = 0 THEN -300 WHEN event_id % 41 = 1 THEN 110 ELSE 0 END - CASE WHEN event_id % 53 = 0 THEN 200 ELSE 0 END + CASE event_id % 43 WHEN 0 THEN -350 WHEN 1 THEN 90 ELSE 0 END",
    "tr_y": "100 + CASE WHEN event_id % 41 = 0 THEN 200 WHEN event_id % 41 = 1 THEN -110 ELSE 0 END + CASE WHEN event_id % 47 = 0 THEN 70 ELSE 0 END",
    "br_x": "900 + CASE WHEN event_id % 41 = 0 THEN -300 WHEN event_id % 41 = 1 THEN 110 ELSE 0 END + CASE event_id % 43 WHEN 0 THEN -350 WHEN 1 THEN 90 ELSE 0 END",
    "br_y": "700 + CASE WHEN event_id % 41 = 0 THEN -200 WHEN event_id % 41 = 1 THEN 110 ELSE 0 END + CASE WHEN event_id % 47 = 0 THEN 70 ELSE 0 END",
    "bl_x": "100 + CASE WHEN event_id % 41 = 0 THEN 300 WHEN event_id % 41 = 1 THEN -110 ELSE 0 END + CASE event_id % 43 WHEN 0 THEN -350 WHEN 1 THEN 170 ELSE 0 END",
    "bl_y": "700 + CASE WHEN event_id % 41 = 0 THEN -200 WHEN event_id % 41 = 1 THEN 110 ELSE 0 END - CASE WHEN event_id % 47 = 0 THEN 70 ELSE 0 END",
}

FRAMES_SQL = (
    """
SELECT user_id AS session_id, event_id,
  CAST(1000000 + 50 * (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS timestamp_ms,
  (event_id % 29) <> 0 AS detected,
  CAST(CASE WHEN event_id % 31 = 0 THEN 40 ELSE 60 + event_id % 40 END AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE event_id % 37 WHEN 0 THEN 'VISA' WHEN 1 THEN 'ID_CARD' WHEN 2 THEN 'GENERIC' WHEN 3 THEN 'UNHEARD_OF' ELSE 'PASSPORT' END AS document_type,
  CAST(1000 AS DOUBLE) AS frame_width, CAST(800 AS DOUBLE) AS frame_height,
  """
    + ",\n  ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in CORNER_SQL.items())
    + """,
  CAST(CASE WHEN event_id % 59 = 0 THEN 20 ELSE 70 + event_id % 90 END AS DOUBLE) AS blur_score,
  CAST(CASE event_id % 61 WHEN 0 THEN 30 WHEN 1 THEN 240 ELSE 80 + event_id % 120 END AS DOUBLE) AS brightness,
  CAST(CASE WHEN event_id % 67 = 0 THEN 15 ELSE event_id % 8 END AS DOUBLE) / CAST(100 AS DOUBLE) AS glare_ratio,
  CAST(CASE WHEN event_id % 71 = 0 THEN 9 ELSE event_id % 4 END AS DOUBLE) / CAST(100 AS DOUBLE) AS motion_score
FROM events"""
)

FACE_FRAMES_SQL = """
SELECT user_id AS session_id, event_id,
  (event_id % 23) <> 0 AS detected,
  CAST(CASE WHEN event_id % 19 = 0 THEN 50 ELSE 60 + event_id % 40 END AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CAST(720 AS DOUBLE) AS frame_width, CAST(1280 AS DOUBLE) AS frame_height,
  CAST(200 + event_id % 40 + CASE WHEN event_id % 43 = 0 THEN 260 ELSE 0 END AS DOUBLE) AS box_x,
  CAST(400 + event_id % 50 + CASE WHEN event_id % 43 = 0 THEN 380 ELSE 0 END AS DOUBLE) AS box_y,
  CAST(CASE event_id % 37 WHEN 0 THEN 90 WHEN 1 THEN 700 ELSE 300 END AS DOUBLE) AS box_w,
  CAST(CASE event_id % 37 WHEN 0 THEN 120 WHEN 1 THEN 1000 ELSE 400 END AS DOUBLE) AS box_h,
  CAST(CASE WHEN event_id % 2 = 0 THEN 280 ELSE 420 END AS DOUBLE) AS right_x, CAST(500 AS DOUBLE) AS right_y,
  CAST(CASE WHEN event_id % 2 = 0 THEN 420 ELSE 280 END AS DOUBLE) AS left_x,
  CAST(500 + CASE WHEN event_id % 41 = 0 THEN 90 ELSE event_id % 12 END AS DOUBLE) AS left_y,
  CAST(CASE WHEN event_id % 53 = 0 THEN 9 ELSE 20 + event_id % 90 END AS DOUBLE) AS blur_score,
  CAST(CASE event_id % 61 WHEN 0 THEN 30 WHEN 1 THEN 250 ELSE 80 + event_id % 120 END AS DOUBLE) AS brightness,
  CAST(CASE WHEN event_id % 67 = 0 THEN 20 ELSE event_id % 14 END AS DOUBLE) / CAST(100 AS DOUBLE) AS glare_ratio,
  CAST(CASE WHEN event_id % 71 = 0 THEN 9 ELSE event_id % 8 END AS DOUBLE) / CAST(100 AS DOUBLE) AS motion_score
FROM events"""


def _digit(text: str) -> str:
    """Check digit of a text of digits, spelled as arithmetic."""
    terms = [f"{(7, 3, 1)[i % 3]} * CAST(SUBSTR({text[0]}, {i + 1}, 1) AS INT)" for i in range(text[1])]
    return f"CAST(({' + '.join(terms)}) % 10 AS VARCHAR(2))"


_PARTS = """
SELECT c_custkey,
  REPLACE(UPPER(n_name), ' ', '<') || '<<' || REPLACE(REPLACE(UPPER(c_name), '#', '<'), ' ', '<') AS names,
  LPAD(CAST((c_custkey * 7919 + 12345) % 1000000000 AS VARCHAR(9)), 9, '0') AS doc_no,
  LPAD(CAST(c_custkey % 100 AS VARCHAR(2)), 2, '0') || LPAD(CAST(1 + c_custkey % 13 AS VARCHAR(2)), 2, '0') || LPAD(CAST(1 + c_custkey % 28 AS VARCHAR(2)), 2, '0') AS dob,
  LPAD(CAST((c_custkey * 3) % 40 AS VARCHAR(2)), 2, '0') || LPAD(CAST(1 + (c_custkey * 5) % 12 AS VARCHAR(2)), 2, '0') || LPAD(CAST(1 + (c_custkey * 11) % 28 AS VARCHAR(2)), 2, '0') AS expiry
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

_LINE2 = f"""doc_no || {_digit(("doc_no", 9))} || 'UT0' || CASE WHEN c_custkey % 5 = 0 THEN REPLACE(dob, '0', 'O') ELSE dob END || CASE WHEN c_custkey % 11 = 0 THEN '9' ELSE {_digit(("dob", 6))} END
    || CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '<' END || expiry || {_digit(("expiry", 6))}"""

#: Zones of every format, some damaged, some with noise lines; every seventh has none.
MRZ_SQL = f"""
SELECT c_custkey, CASE c_custkey % 7
  WHEN 6 THEN 'NO ZONE HERE' || CHR(10) || names
  WHEN 5 THEN 'visa' || CHR(10) || SUBSTR(RPAD('V<UTO' || names, 60, '<'), 1, 36) || CHR(10) || SUBSTR(RPAD({_LINE2}, 60, '<'), 1, 35)
  WHEN 4 THEN SUBSTR(RPAD('I<UTO' || doc_no || {_digit(("doc_no", 9))}, 60, '<'), 1, 30) || CHR(10) || SUBSTR(RPAD(dob || {_digit(("dob", 6))} || 'M' || expiry || {_digit(("expiry", 6))} || 'UTO', 60, '<'), 1, 29) || CHR(10) || SUBSTR(RPAD(names, 60, '<'), 1, 30)
  WHEN 3 THEN SUBSTR(RPAD('V<UTO' || names, 60, '<'), 1, 44) || CHR(10) || SUBSTR(RPAD({_LINE2}, 60, '<'), 1, 44)
  WHEN 2 THEN 'PASSPORT' || CHR(10) || ' ' || LOWER(SUBSTR(RPAD('P<UTO' || names, 60, '<'), 1, 43)) || CHR(10) || CHR(10) || SUBSTR(RPAD({_LINE2}, 60, '<'), 1, 44)
  ELSE SUBSTR(RPAD('P<UTO' || names, 60, '<'), 1, 44) || CHR(10) || SUBSTR(RPAD({_LINE2}, 60, '<'), 1, 44) END AS text
FROM ({_PARTS}) parts"""

#: Card texts, one row a line; line_idx from 0, y in 0..1.
_LICENCE_LINES = {
    0: "CASE WHEN o_orderkey % 6 = 0 THEN 'UNITED KINGDOM' ELSE 'DRIVING LICENCE' END",
    1: "CASE WHEN o_orderkey % 4 = 0 THEN '1.' ELSE '1. MORGAN ' || SUBSTR('ABCDEFGHIJ', CAST(1 + o_orderkey % 10 AS INT), 3) END",
    2: "CASE WHEN o_orderkey % 4 = 0 THEN 'MORGAN' ELSE '2. SARAH MEREDYTH' END",
    3: "'3. ' || LPAD(CAST(1 + o_custkey % 31 AS VARCHAR(2)), 2, '0') || '.' || LPAD(CAST(1 + o_custkey % 13 AS VARCHAR(2)), 2, '0') || '.' || CAST(1950 + o_custkey % 50 AS VARCHAR(4)) || ' UNITED KINGDOM'",
    4: "'4a. 19.01.' || CAST(2001 + o_orderkey % 15 AS VARCHAR(4))",
    5: "CASE WHEN o_orderkey % 3 = 0 THEN '4b. ----' ELSE '4b. 18-01-' || CAST(2021 + o_orderkey % 15 AS VARCHAR(4)) END",
    6: "CASE WHEN o_orderkey % 7 = 0 THEN '5. NONE' ELSE '5. M0RGA' || LPAD(CAST(o_custkey % 100 AS VARCHAR(2)), 2, '0') || LPAD(CAST(1 + o_orderkey % 62 AS VARCHAR(2)), 2, '0') || 'I6SM9IJ' END",
    7: "'8. ' || CAST(1 + o_orderkey % 200 AS VARCHAR(3)) || ' BURNS CRESCENT'",
    8: "'EDINBURGH'",
    9: "'EH1 9GP'",
    10: "CASE o_orderkey % 3 WHEN 0 THEN '9. AM/A1/B' WHEN 1 THEN '9. B, BE, C1, B,' ELSE 'NOTHING' END",
}
_CARD_LINES = {
    0: "'REPUBLIC OF UTOPIA'",
    1: "CASE WHEN o_orderkey % 3 = 0 THEN 'IDENTITY CARD' ELSE 'Card' END",
    2: "CASE WHEN o_orderkey % 2 = 0 THEN 'ANNA MARIA ERIKSSON' ELSE 'ANNA LEE' END",
    3: "CASE WHEN o_orderkey % 2 = 0 THEN 'BO ERIKSSON' ELSE 'x' END",
    4: "'NUMBER: AB' || LPAD(CAST(o_orderkey AS VARCHAR(9)), 7, '0')",
    5: "'DOB ' || CAST(1 + o_custkey % 32 AS VARCHAR(2)) || '.' || CAST(1 + o_custkey % 13 AS VARCHAR(2)) || '.' || CAST(1950 + o_custkey % 50 AS VARCHAR(4))",
    6: "CASE WHEN o_orderkey % 5 = 0 THEN 'no expiry' ELSE 'EXPIRY 15/04/' || CAST(2021 + o_orderkey % 15 AS VARCHAR(4)) END",
    7: "CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE 'ADDRESS: ' || CAST(1 + o_orderkey % 99 AS VARCHAR(2)) || ' MAIN ST' END",
    8: "'UTOPOLIS'",
    9: "' UT1 2AA '",
}


def _lines_sql(lines: dict[int, str]) -> str:
    """One scan of orders, crossed with its fixed line numbers."""
    cases = " ".join(f"WHEN {i} THEN {text}" for i, text in lines.items())
    numbers = " UNION ALL ".join(f"SELECT {i} AS line_idx" for i in lines)
    return f"""
SELECT o_orderkey AS capture_id, line_idx, CASE line_idx {cases} END AS text,
  CAST(60 + (o_orderkey + line_idx) % 40 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CAST(0.1 AS DOUBLE) AS x, CAST(line_idx AS DOUBLE) / CAST({len(lines)} AS DOUBLE) AS y, CAST(0.8 AS DOUBLE) AS width, CAST(0.05 AS DOUBLE) AS height
FROM orders CROSS JOIN ({numbers}) numbers"""


LICENCE_LINES_SQL, CARD_LINES_SQL = _lines_sql(_LICENCE_LINES), _lines_sql(_CARD_LINES)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a projection over the tables it names."""
    for name in TABLES:
        if f" {name}" in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)
