-- Counts and durations of flows that ended, and errors of flows that started, in the `minutes` complete minutes before the last one.
-- A flow leads from instances whose name is like `first_dn` to those like `last_dn` with the same correlation id. Starts are counted
-- once per flow and id, so an id with many starts and ends does not pair them all.
CREATE OR REPLACE TEMPORARY FUNCTION flow_statistics(
  as_of TIMESTAMP_NTZ, minutes INT, flows ARRAY<STRUCT<flow: STRING, first_dn: STRING, last_dn: STRING>>)
RETURNS TABLE (
  time STRING, flow STRING, count_all BIGINT, count_ok BIGINT, count_err BIGINT, min DOUBLE, max DOUBLE, avg DOUBLE)
RETURN
WITH starts AS (
  SELECT id, ecid, created, inline(filter(flows, f -> composite_dn LIKE f.first_dn)) FROM instances
),
spans AS (
  SELECT flow, ecid, count(*) AS n, min(unix_micros(CAST(created AS TIMESTAMP))) AS first, max(unix_micros(CAST(created AS TIMESTAMP))) AS last,
    sum(CAST(unix_micros(CAST(created AS TIMESTAMP)) AS DECIMAL(20, 0))) AS total
  FROM starts GROUP BY flow, ecid
),
ends AS (
  SELECT ecid, created, unix_micros(CAST(created AS TIMESTAMP)) AS at, inline(filter(flows, f -> composite_dn LIKE f.last_dn))
  FROM instances
  WHERE created >= CAST(date_trunc('MINUTE', as_of - make_dt_interval(0, 0, minutes + 1, 0)) AS TIMESTAMP_NTZ) AND created < CAST(date_trunc('MINUTE', as_of - INTERVAL 1 MINUTE) AS TIMESTAMP_NTZ)
),
outcomes AS (
  SELECT e.flow, date_trunc('MINUTE', e.created) AS minute, s.n AS ok, 0L AS failed, e.at - s.last AS shortest, e.at - s.first AS longest, s.n * e.at - s.total AS total
  FROM ends e JOIN spans s ON e.flow = s.flow AND e.ecid = s.ecid
  UNION ALL
  SELECT s.flow, date_trunc('MINUTE', s.created), 0L, 1L, NULL, NULL, NULL
  FROM starts s JOIN faults f ON s.id = f.composite_instance_id
  WHERE s.created >= CAST(date_trunc('MINUTE', as_of - make_dt_interval(0, 0, minutes + 1, 0)) AS TIMESTAMP_NTZ) AND s.created < CAST(date_trunc('MINUTE', as_of - INTERVAL 1 MINUTE) AS TIMESTAMP_NTZ)
)
SELECT date_format(minute, 'yy-MM-dd HH:mm'), flow, sum(ok) + sum(failed), sum(ok), sum(failed),
  round(min(shortest) / 1e6D, 2), round(max(longest) / 1e6D, 2), round(CAST(sum(total) AS DOUBLE) / nullif(sum(ok), 0) / 1e6D, 2)
FROM outcomes GROUP BY flow, minute
