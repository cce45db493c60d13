-- Aggregated entities by type at a point in time.
SELECT date_format(:as_of, 'yy-MM-dd HH:mm') AS time, entity_type, count(*) AS count
FROM ${ENTITY}entities
GROUP BY entity_type
