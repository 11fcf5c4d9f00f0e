-- Sightings by path from a moment on.
SELECT path_id, count(*) AS n, min(ts) AS first_ts
FROM sightings
-- the moment is a parameter
WHERE ts >= :since
GROUP BY path_id
