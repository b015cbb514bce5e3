"""Views that give the driver's tables the shape of correspondence data. The same text runs in Spark
SQL and in DuckDB; E0 keeps literals DOUBLE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitweave.storage import table

#: The homography that the correspondences of `corr` follow, row-major.
TRUE_H = [1.02, 0.01, 5.0, -0.01, 0.98, -3.0, 0.0, 0.0, 1.0]

VIEWS: dict[str, tuple[list[str], str]] = {
    "corr": (["events"], """
WITH b AS (
  SELECT event_id AS match_id, user_id % 50 AS pair_id, event_type, value,
         CAST((event_id * 7919) % 1021 AS DOUBLE) AS sx, CAST((event_id * 104729) % 1019 AS DOUBLE) AS sy,
         CAST((event_id * 31) % 7 - 3 AS DOUBLE) * 0.25E0 AS nx, CAST((event_id * 17) % 7 - 3 AS DOUBLE) * 0.25E0 AS ny
  FROM {events})
SELECT match_id, pair_id, event_type, sx AS source_x, sy AS source_y,
       1.02E0 * sx + 0.01E0 * sy + 5.0E0 + nx + CASE WHEN event_type = 'error' THEN 40.0E0 + CAST(match_id % 13 AS DOUBLE) ELSE 0.0E0 END AS reference_x,
       -0.01E0 * sx + 0.98E0 * sy - 3.0E0 + ny + CASE WHEN event_type = 'error' THEN -25.0E0 ELSE 0.0E0 END AS reference_y,
       least(1.0E0, value / 100.0E0) AS confidence
FROM b"""),
    "corr_rev": (["corr"], """
SELECT match_id AS rev_id, pair_id, reference_x + 0.5E0 AS source_x, reference_y - 0.5E0 AS source_y,
       source_x + 0.5E0 AS reference_x, source_y + 0.5E0 AS reference_y, confidence * 0.9E0 AS confidence
FROM {corr} WHERE match_id % 3 <> 0"""),
    "corr_multi": (["corr"], """
SELECT match_id, 1 AS pass_id, pair_id, source_x, source_y, reference_x, reference_y, confidence FROM {corr}
UNION ALL
SELECT match_id + 10000000 AS match_id, 2 AS pass_id, pair_id, source_x + 1.0E0, source_y, reference_x + 1.0E0, reference_y, confidence * 0.9E0
FROM {corr} WHERE match_id % 5 = 0"""),
    "pixels": (["orders"], """
SELECT CAST(floor(o_orderkey / 1024) AS BIGINT) AS image_id, CAST(floor((o_orderkey % 1024) / 32) AS BIGINT) AS y, o_orderkey % 32 AS x,
       CASE WHEN o_orderkey % 29 = 0 THEN -9999 ELSE CAST(floor(o_totalprice / 100.0E0) AS INT) END AS v
FROM {orders}"""),
    "terrain": (["pixels"], """
SELECT y + 32 * CAST(floor(image_id / 8) AS BIGINT) AS y, x + 32 * (image_id % 8) AS x, CASE WHEN v = -9999 THEN -9999 ELSE v + 1737400 END AS v FROM {pixels}"""),
    "rays": (["events"], """
WITH p AS (SELECT event_id, radians(28.0E0 + CAST((event_id * 7919) % 36000 AS DOUBLE) / 1000.0E0) AS lo, radians(21.0E0 - CAST((event_id * 104729) % 10000 AS DOUBLE) / 1000.0E0) AS la,
                  radians(CAST(event_id % 5 AS DOUBLE) * 5.0E0) AS tilt, CASE WHEN event_id % 97 = 0 THEN -1.0E0 ELSE 1.0E0 END AS side FROM {events})
SELECT event_id, 1837400.0E0 * cos(la) * cos(lo) AS ox, 1837400.0E0 * cos(la) * sin(lo) AS oy, 1837400.0E0 * sin(la) AS oz,
       -side * cos(tilt) * cos(la) * cos(lo) - sin(tilt) * sin(lo) AS dx, -side * cos(tilt) * cos(la) * sin(lo) + sin(tilt) * cos(lo) AS dy, -side * cos(tilt) * sin(la) AS dz
FROM p"""),
    "series": (["events"], "SELECT user_id % 50 AS series_id, event_id AS record_number, ts AS time, value FROM {events} WHERE event_type = 'view'"),
    "probe": (["events"], "SELECT user_id % 50 AS series_id, event_id AS probe_id, ts AS time FROM {events} WHERE event_type = 'click'"),
    "oat_lines": (["events"], """
SELECT event_id, concat('ORBTATTD', lpad(CAST(event_id AS STRING), 6, ' '), '    ', '2024', '   1',
       lpad(CAST(1 + event_id % 28 AS STRING), 4, ' '), lpad(CAST(event_id % 24 AS STRING), 4, ' '), lpad(CAST(event_id % 60 AS STRING), 4, ' '),
       lpad(CAST((event_id * 7) % 60 AS STRING), 4, ' '), lpad(CAST((event_id * 13) % 1000 AS STRING), 4, ' ')) AS line
FROM {events}"""),
    "label_lines": (["part"], """
SELECT p_partkey AS line_no,
       CASE p_partkey % 4
         WHEN 0 THEN concat('  MAP_SCALE_', CAST(p_partkey % 7 AS STRING), ' = ', CAST(p_size AS STRING), '.5 <km/pixel>')
         WHEN 1 THEN concat('NAME_', CAST(p_partkey % 7 AS STRING), '="', p_name, '"')
         WHEN 2 THEN concat('TYPE = ', p_type, '  ')
         ELSE concat('/* ', p_name, ' */') END AS line
FROM {part}"""),
    "runs": (["orders"], """
SELECT md5(CAST(o_orderkey AS STRING)) AS run_id, o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'insufficient_matches' ELSE 'failed' END AS status, o_totalprice AS total_seconds
FROM {orders}"""),
    "angles": (["events"], """
SELECT event_id, CAST((event_id * 37) % 1441 AS DOUBLE) / 2.0E0 - 360.0E0 AS lon, 60.0E0 + CAST(event_id % 300 AS DOUBLE) / 10.0E0 AS lat,
       CAST((event_id * 13) % 2001 AS DOUBLE) - 1000.0E0 AS elevation, CAST((event_id * 11) % 721 AS DOUBLE) - 360.0E0 AS ref
FROM {events}"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needs, text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """WITH clause for DuckDB of these views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1].format(**{x: x for x in VIEWS[n][0]})})" for n in order)
