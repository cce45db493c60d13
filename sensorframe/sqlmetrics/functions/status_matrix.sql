-- Messages per component, container and pair of group and message status, with labels; both statuses at most `max_status`.
CREATE OR REPLACE TEMPORARY FUNCTION status_matrix(as_of TIMESTAMP_NTZ, max_status INT)
RETURNS TABLE (time STRING, status STRING, group_status BIGINT, message_status BIGINT, count BIGINT, component STRING, container_id BIGINT)
RETURN
SELECT date_format(as_of, 'yyyy-MM-dd HH:mm:ss'),
  -- Fixed values: status codes of message groups and of messages.
  concat(
    CASE group_status WHEN 0 THEN 'READY' WHEN 1 THEN 'LOCKED' WHEN 3 THEN 'ERRORED' WHEN 4 THEN 'TIMED OUT' WHEN 6 THEN 'GROUP ERROR' ELSE '' END, '-',
    CASE message_status WHEN 0 THEN 'READY' WHEN 2 THEN 'PROCESSED' WHEN 3 THEN 'ERRORED' WHEN 4 THEN 'TIMED OUT' WHEN 6 THEN 'ABORTED' ELSE '' END),
  group_status, message_status, count, substring_index(component_dn, '/', -1), container_id
FROM (
  SELECT g.component_dn, g.group_status, m.message_status, g.container_id, count(*) AS count
  FROM message_groups g JOIN messages m ON m.owner_id = g.owner_id AND m.group_id = g.group_id
  WHERE g.group_status <= max_status AND m.message_status <= max_status
  GROUP BY ALL
)
