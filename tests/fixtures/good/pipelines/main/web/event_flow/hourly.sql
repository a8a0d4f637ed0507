SELECT kind, hour, count(*) AS n, round(avg(amount), 4) AS avg_amount
FROM vw__silver__events
GROUP BY kind, hour
