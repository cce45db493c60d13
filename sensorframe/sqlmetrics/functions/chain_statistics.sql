-- Whole-flow times per chain of components: `steps` are grouped by correlation id, chains by the ordered names of their steps.
-- Only ids whose first step lies in the `minutes` complete minutes before the last one count.
CREATE OR REPLACE TEMPORARY FUNCTION chain_statistics(as_of TIMESTAMP_NTZ, minutes INT)
RETURNS TABLE (
  count BIGINT, count_faulted BIGINT, min_time DOUBLE, max_time DOUBLE, avg_time DOUBLE, p50 DOUBLE, p90 DOUBLE, p95 DOUBLE, sample_cid BIGINT,
  entry_point STRING, cdns STRING)
RETURN
WITH chains AS (
  SELECT ecid, min(instance_id) AS instance_id, min(faulted_time) AS faulted_time,
    (unix_micros(CAST(max(end_time) AS TIMESTAMP)) - unix_micros(CAST(min(created) AS TIMESTAMP))) / 1e6D AS seconds,
    array_join(sort_array(collect_list(struct(created, instance_id, cdn))).cdn, ', ') AS cdns
  FROM steps GROUP BY ecid
  HAVING min(created) >= CAST(date_trunc('MINUTE', as_of - make_dt_interval(0, 0, minutes + 1, 0)) AS TIMESTAMP_NTZ) AND min(created) < CAST(date_trunc('MINUTE', as_of - INTERVAL 1 MINUTE) AS TIMESTAMP_NTZ)
),
-- Equal times of a chain are one row with a count, so percentiles rank distinct times.
times AS (
  SELECT cdns, seconds, count(*) AS n, count(faulted_time) AS faulted, min(instance_id) AS instance_id FROM chains GROUP BY cdns, seconds
),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY cdns ORDER BY seconds) AS upto, sum(n) OVER (PARTITION BY cdns) AS whole FROM times
)
SELECT sum(n), sum(faulted), round(min(seconds), 3), round(max(seconds), 3), round(sum(seconds * n) / sum(n), 3),
  min(seconds) FILTER (WHERE upto >= 0.5BD * whole), min(seconds) FILTER (WHERE upto >= 0.9BD * whole), min(seconds) FILTER (WHERE upto >= 0.95BD * whole),
  min(instance_id), substring_index(cdns, ',', 1), cdns
FROM ranked GROUP BY cdns
