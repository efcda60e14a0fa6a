"""Reference SQL (DuckDB dialect) shared by the queries' check statements."""

from __future__ import annotations

import re

HAV = "(2*6371008.8e0*asin(least(1e0,sqrt(pow(sin(radians({b1}-({a1}))/2),2)+cos(radians({a1}))*cos(radians({b1}))*pow(sin(radians({b2}-({a2}))/2),2)))))"


def hav(a1: str, a2: str, b1: str, b2: str) -> str:
    """Great-circle meters between (lat a1, lon a2) and (lat b1, lon b2)."""
    return HAV.format(a1=a1, a2=a2, b1=b1, b2=b2)


CTES = {
    "ev": "SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events",
    "pings": """SELECT event_id, user_id, t,
 -22.9e0 + CAST(((event_id*7919)%200)//40 AS DOUBLE)*0.001e0 + CAST(event_id%10 AS DOUBLE)*0.00001e0 AS lat,
 -43.2e0 + CAST(((event_id*7919)%200)%40 AS DOUBLE)*0.001e0 + CAST((event_id//10)%10 AS DOUBLE)*0.00001e0 AS lon
FROM ev""",
    "pings_q": """SELECT event_id, user_id, (t//900)*900 AS t,
 -22.9e0 + CAST((event_id*7919)%3 AS DOUBLE)*0.01e0 + CAST(event_id%10 AS DOUBLE)*0.00001e0 AS lat,
 -43.2e0 + CAST(event_id%10 AS DOUBLE)*0.00001e0 AS lon FROM pings""",
    "nodes": """SELECT p_partkey AS node_id, -22.9e0 + CAST(p_partkey//40 AS DOUBLE)*0.001e0 AS lat,
 -43.2e0 + CAST(p_partkey%40 AS DOUBLE)*0.001e0 AS lon FROM part""",
    "way_nodes": """SELECT 1000000+(n.node_id//40)*100+b.k AS way_id, n.node_id, n.node_id%40-4*b.k AS seq
FROM nodes n JOIN (SELECT CAST(unnest(range(0,10)) AS BIGINT) AS k) b ON n.node_id%40 BETWEEN 4*b.k AND 4*b.k+4
UNION ALL
SELECT 2000000+(n.node_id%40)*100000+b.k, n.node_id, n.node_id//40-4*b.k
FROM nodes n JOIN (SELECT CAST(unnest(range(0,(SELECT max(p_partkey)//160+1 FROM part))) AS BIGINT) AS k) b ON n.node_id//40 BETWEEN 4*b.k AND 4*b.k+4""",
    "ways": """SELECT DISTINCT way_id,
 CASE way_id%7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'tertiary' WHEN 4 THEN 'residential' WHEN 5 THEN 'service' ELSE 'footway' END AS highway,
 way_id%5=0 OR way_id%7=0 AS is_oneway, CASE WHEN way_id%50=1 THEN 1 ELSE 0 END AS layer, way_id%50=1 AS is_bridge,
 concat('Road ', CAST(way_id//100 AS VARCHAR)) AS name
FROM way_nodes""",
    "activities": """SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'walking' WHEN 'view' THEN 'driving' WHEN 'error' THEN 'Cycling' WHEN 'signup' THEN 'STILL' ELSE 'other' END AS raw_type,
 value/500e0 AS probability, t AS start_t, CASE WHEN event_id%11=0 THEN NULL ELSE t+CAST(floor(value) AS BIGINT)*10 END AS end_t
FROM ev""",
    "act_typed": """SELECT *, CASE lower(raw_type) WHEN 'still' THEN 'still' WHEN 'walking' THEN 'walking' WHEN 'running' THEN 'running' WHEN 'on_bicycle' THEN 'on_bicycle' WHEN 'cycling' THEN 'on_bicycle' WHEN 'in_vehicle' THEN 'in_vehicle' WHEN 'driving' THEN 'in_vehicle' WHEN 'on_foot' THEN 'on_foot' ELSE 'unknown' END AS type,
 CAST(round(probability*100) AS INTEGER) AS confidence FROM activities""",
    "visits": "SELECT event_id, user_id, lat, lon, t AS arrival_t, t+(event_id%90)*60 AS departure_t FROM pings",
    "batches": """SELECT user_id*100000+(t//86400) AS batch_id, user_id, (t//86400) AS day, min(t) AS batch_t, count(*) AS n_points,
 CASE WHEN (t//86400)%7=0 THEN NULL ELSE (t//86400)%3=0 END AS processed, (t//86400)%5<>0 AS ready
FROM pings GROUP BY user_id, t//86400""",
    "maxspeed": """SELECT p_partkey AS id, CASE p_size%4 WHEN 0 THEN concat(CAST(p_size AS VARCHAR),' mph') WHEN 1 THEN concat(CAST(p_size AS VARCHAR),' km/h') WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE 'none' END AS raw FROM part""",
    "accounts": """SELECT c_custkey AS id, c_name AS first_name, c_mktsegment AS last_name,
 concat(lower(c_mktsegment), '.', CAST(c_nationkey AS VARCHAR), '@mail.test') AS email,
 CAST(round(c_acctbal * 100) AS BIGINT) AS last_modified_t FROM customer""",
    # Trips: flag breaks, number them, aggregate.
    "pseq": f"""SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pings
WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""",
    "trip_pts": f"""SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS trip_no FROM (
 SELECT *, {hav('plat', 'plon', 'lat', 'lon')} AS d,
 CASE WHEN pt IS NULL OR t-pt>900 OR ({hav('plat', 'plon', 'lat', 'lon')}<50 AND t-pt>=900) THEN 1 ELSE 0 END AS brk FROM pseq) s""",
    "trips": """SELECT user_id, trip_no, min(t) AS start_t, max(t) AS end_t, count(*) AS n_points,
 coalesce(sum(CASE WHEN brk=0 THEN d END),0) AS distance_m,
 min(lon)-0.001e0 AS min_lon, min(lat)-0.001e0 AS min_lat, max(lon)+0.001e0 AS max_lon, max(lat)+0.001e0 AS max_lat
FROM trip_pts GROUP BY user_id, trip_no HAVING count(*)>=2""",
    "trips_id": """SELECT *, sha256(concat_ws('|', CAST(user_id AS VARCHAR), CAST(start_t AS VARCHAR), CAST(end_t AS VARCHAR))) AS trip_id FROM trips""",
    "trip_points": """SELECT p.user_id, tr.trip_id, p.t, p.event_id, p.lat, p.lon, tr.n_points,
 row_number() OVER (PARTITION BY p.user_id, p.trip_no ORDER BY p.t, p.event_id)-1 AS point_idx
FROM trip_pts p JOIN trips_id tr ON p.user_id=tr.user_id AND p.trip_no=tr.trip_no""",
    # Network.
    "road_ways": """SELECT * FROM ways WHERE highway IN ('motorway','trunk','primary','secondary','tertiary','motorway_link','trunk_link','primary_link','secondary_link','tertiary_link','residential','living_street','unclassified','service')""",
    "seg": """SELECT row_number() OVER (ORDER BY w.way_id) AS segment_id, w.*, g.nodes, g.xs, g.ys, len(g.nodes) AS n_nodes
FROM road_ways w JOIN (SELECT wn.way_id, list(n.node_id ORDER BY wn.seq) AS nodes, list(n.lon ORDER BY wn.seq) AS xs, list(n.lat ORDER BY wn.seq) AS ys
 FROM way_nodes wn JOIN nodes n ON wn.node_id=n.node_id GROUP BY wn.way_id HAVING count(*)>1) g ON w.way_id=g.way_id""",
    "sn": """SELECT s.segment_id, s.way_id, s.highway, s.is_oneway, s.name, s.layer, s.is_bridge, s.nodes[1] AS first_node, s.nodes[n_nodes] AS last_node, n_nodes-1 AS last_idx,
 r.i-1 AS idx, s.nodes[r.i] AS node_id, s.xs[r.i] AS lon, s.ys[r.i] AS lat
FROM seg s, unnest(range(1, s.n_nodes+1)) AS r(i)""",
    "pc": """SELECT segment_id, idx AS piece, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by_ FROM sn
WINDOW w AS (PARTITION BY segment_id ORDER BY idx) QUALIFY bx IS NOT NULL""",
    "conn": """SELECT DISTINCT src, dst FROM (
 SELECT a.segment_id AS src, b.segment_id AS dst FROM sn a JOIN sn b ON a.node_id=b.node_id AND a.segment_id<>b.segment_id
  AND b.node_id IN (b.first_node,b.last_node)
 WHERE (a.idx>0 AND a.idx<a.last_idx)
  OR ((a.node_id=a.last_node OR (NOT a.is_oneway AND a.node_id=a.first_node)) AND (NOT b.is_oneway OR b.node_id=b.first_node))
 UNION ALL
 SELECT b.segment_id, a.segment_id FROM sn a JOIN sn b ON a.node_id=b.node_id AND a.segment_id<>b.segment_id
  AND b.node_id IN (b.first_node,b.last_node)
 WHERE a.idx>0 AND a.idx<a.last_idx AND (NOT b.is_oneway OR b.node_id=b.first_node))""",
    "grp": """SELECT * FROM (VALUES ('motorway',0),('primary',2),('secondary',3),('tertiary',4),('residential',5),('service',5)) g(highway, g)""",
    "pairs": """SELECT a.segment_id AS a_id, b.segment_id AS b_id, a.node_id, a.idx AS ai, b.idx AS bi, a.last_idx AS al, b.last_idx AS bl,
 a.is_oneway AS ao, b.is_oneway AS bo, a.way_id AS aw, b.way_id AS bw, a.highway AS ah, b.highway AS bh, a.name AS an, b.name AS bn,
 a.node_id IN (a.first_node,a.last_node) OR b.node_id IN (b.first_node,b.last_node) AS at_end, abs(ga.g-gb.g)<=2 AS compat
FROM sn a JOIN sn b ON a.node_id=b.node_id AND a.segment_id<b.segment_id AND a.layer=b.layer AND a.is_bridge=b.is_bridge
 JOIN grp ga ON ga.highway=a.highway JOIN grp gb ON gb.highway=b.highway""",
    "conn2": """SELECT a_id, b_id FROM (SELECT a_id, b_id FROM pairs GROUP BY a_id, b_id
 HAVING bool_or(at_end) OR bool_or(aw=bw) OR bool_or(an=bn) OR count(*)>=2 OR bool_or(compat)) p
WHERE NOT EXISTS (SELECT 1 FROM conn c WHERE (c.src=p.a_id AND c.dst=p.b_id) OR (c.src=p.b_id AND c.dst=p.a_id))""",
    "allconn": "SELECT src, dst FROM conn UNION ALL SELECT a_id, b_id FROM conn2 UNION ALL SELECT b_id, a_id FROM conn2",
    "fac": """SELECT * FROM (VALUES ('motorway',0.5e0),('primary',0.9e0),('secondary',1.2e0),('tertiary',1.5e0),('residential',2.0e0),('service',3.0e0)) f(highway, f)""",
    "met": """SELECT c.src, c.dst, s.idx AS i, o.idx AS j, s.last_idx AS li, o.last_idx AS lj, s.is_oneway AND o.is_oneway AS bo,
 f.f*CASE WHEN s.way_id=o.way_id THEN 0.9e0 ELSE 1.0e0 END+1.0e0 AS cost
FROM allconn c JOIN sn s ON s.segment_id=c.src JOIN sn o ON o.segment_id=c.dst AND o.node_id=s.node_id JOIN fac f ON f.highway=o.highway
QUALIFY row_number() OVER (PARTITION BY c.src, c.dst ORDER BY s.idx, o.idx)=1""",
    "dedges": """SELECT src, dst, min(cost) AS cost FROM (
 SELECT src, dst, cost FROM met WHERE NOT (bo AND j=lj) UNION ALL SELECT dst, src, cost FROM met WHERE NOT (bo AND i=li)) GROUP BY src, dst""",
    "pairs2": """SELECT p.*, f.f*CASE WHEN p.aw=p.bw THEN 0.9e0 ELSE 1.0e0 END+1.0e0 AS cost FROM pairs p JOIN fac f ON f.highway=p.bh
WHERE p.compat AND NOT EXISTS (SELECT 1 FROM dedges d WHERE d.src=p.a_id AND d.dst=p.b_id)""",
    "edges": """SELECT src, dst, min(cost) AS cost FROM (
 SELECT src, dst, cost FROM dedges UNION ALL SELECT a_id, b_id, cost FROM pairs2 WHERE NOT (ao AND bo AND bi=bl)
 UNION ALL SELECT b_id, a_id, cost FROM pairs2 WHERE NOT (ao AND bo AND ai=al)) GROUP BY src, dst""",
}

MATERIALIZE = {"pseq", "trip_pts", "trips", "seg", "sn", "pc", "conn", "pairs", "conn2", "allconn", "dedges", "edges", "near", "cand", "trips_id", "trip_points"}


def with_ctes(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` preceded by every shared view it needs, in order of need."""
    views = {**CTES, **(extra or {})}
    order: list[str] = []

    def need(sql: str) -> None:
        for name in views:
            if name not in order and re.search(rf"\b{name}\b(?!\.)", sql):
                if name in _stack:
                    continue
                _stack.add(name)
                need(views[name])
                _stack.discard(name)
                if name not in order:
                    order.append(name)

    _stack: set[str] = set()
    need(body)
    parts = [f"{n} AS {'MATERIALIZED ' if n in MATERIALIZE else ''}({views[n]})" for n in order]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
