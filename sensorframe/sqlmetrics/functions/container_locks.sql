-- Groups in error and locked groups per container, for containers that hold such a group or have a lease.
-- Groups are counted per container before they meet the leases.
CREATE OR REPLACE TEMPORARY FUNCTION container_locks(as_of TIMESTAMP_NTZ)
RETURNS TABLE (time STRING, container_id BIGINT, error_groups BIGINT, locked_groups BIGINT)
RETURN
WITH held AS (
  SELECT container_id, count_if(group_status = 3) AS errors, count_if(group_status = 1) AS locked FROM message_groups GROUP BY container_id
),
leased AS (SELECT container_id, renewal_time, count(*) AS leases FROM leases GROUP BY container_id, renewal_time)
SELECT date_format(as_of, 'yyyy-MM-dd HH:mm:ss'), h.container_id, h.errors * coalesce(l.leases, 1L), h.locked * coalesce(l.leases, 1L)
FROM held h LEFT JOIN leased l ON h.container_id = l.container_id WHERE h.errors + h.locked > 0
UNION
SELECT date_format(as_of, 'yyyy-MM-dd HH:mm:ss'), h.container_id, coalesce(h.errors * l.leases, 0L), coalesce(h.locked * l.leases, 0L)
FROM leased l LEFT JOIN held h ON h.container_id = l.container_id
