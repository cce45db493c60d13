-- Faults of the `minutes` complete minutes before the last one per flow and type of error, with the time of the newest first fault.
-- The type is read from the longest message of a correlation id, the flow is the first of `flows` that the instance of its first
-- fault is like.
CREATE OR REPLACE TEMPORARY FUNCTION error_taxonomy(
  as_of TIMESTAMP_NTZ, minutes INT, flows ARRAY<STRUCT<flow: STRING, dn: STRING, title: STRING>>)
RETURNS TABLE (time STRING, flow STRING, count BIGINT, error_type STRING)
RETURN
WITH marked AS (
  SELECT fault_id, ecid, composite_instance_id, created, error_message,
    created >= CAST(date_trunc('MINUTE', as_of - make_dt_interval(0, 0, minutes + 1, 0)) AS TIMESTAMP_NTZ) AND created < CAST(date_trunc('MINUTE', as_of - INTERVAL 1 MINUTE) AS TIMESTAMP_NTZ) AS inside
  FROM faults
),
ids AS (
  SELECT ecid, min_by(composite_instance_id, struct(created, fault_id)) AS id, min(created) AS first_created,
    min_by(error_message, struct(-coalesce(length(error_message), -1), created, fault_id)) AS message,
    count_if(inside) AS faults
  FROM marked GROUP BY ecid
),
-- Fixed values: patterns of error codes and phrases, in the order in which what they find is joined.
codes AS (
  SELECT id, first_created, faults,
    regexp_extract(message, '(?i)(XML-[0-9]+)') AS xml,
    regexp_extract(message, '(?i)ErrMsg=([_0-9a-zA-Z]+)') AS brm,
    regexp_extract(message, '(?i)(JCA-[0-9]+)') AS jca,
    regexp_extract(message, '(?i)(ORAMED-[0-9]+)') AS oramed,
    regexp_extract(message, '(?i)(SBL-[A-Z]+-[0-9]+)') AS sbl,
    CASE WHEN contains(message, 'Unable to access the following endpoint') THEN 'HTTP_TIMEOUT'
      WHEN contains(message, 'The transaction might have timedout') THEN 'JTA_TIMEOUT'
      WHEN contains(message, 'The result of from-spec is null') THEN 'DATA_ERROR' ELSE '' END AS phrase,
    regexp_extract(message, '(?i)(AIA_ERR_[_A-Z0-9]+)') AS aia,
    regexp_extract(message, '(?i)(BRM-ERR[_0-9a-zA-Z]+)') AS brm2,
    regexp_extract(message, '(?i)(ERRJMS[_0-9a-zA-Z]+)') AS jms
  FROM ids WHERE faults > 0
)
SELECT date_format(max(first_created), 'yy-MM-dd HH:mm'), flow, sum(faults), error_type
FROM (
  SELECT c.first_created, c.faults,
    coalesce(
      try_element_at(filter(flows, f -> composite_dn LIKE f.dn AND coalesce(title, '') LIKE f.title), 1).flow,
      concat('UNKNOWN - ', regexp_extract(composite_dn, 'default/(.*)!'))) AS flow,
    coalesce(nullif(concat(xml, brm, jca, oramed, sbl, phrase, aia, if(brm = '', brm2, ''), jms), ''), 'UNKNOWN_ERROR') AS error_type
  FROM codes c JOIN instances i ON c.id = i.id
)
GROUP BY flow, error_type
