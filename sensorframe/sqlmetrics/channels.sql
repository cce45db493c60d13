-- Instances of the last completed minute per channel (the prefix of the title).
SELECT
  date_format(date_trunc('MINUTE', created), 'yy-MM-dd HH:mm') AS time,
  CASE WHEN substr(title, 1, 3) IN ('SBL', 'IVR', 'WEB', 'PNT', 'TIL') THEN substr(title, 1, 3) ELSE '-OTHER' END AS channel,
  count(*) AS count
FROM ${FLOW}instances
WHERE created >= date_trunc('MINUTE', :as_of - INTERVAL 2 MINUTE) AND created < date_trunc('MINUTE', :as_of - INTERVAL 1 MINUTE)
GROUP BY 1, 2
