"""The warehouse queries in SQL: plain windows for the ledger, recursion for chariots and tours."""

from __future__ import annotations

from skuflow.functions import labels as L
from skuflow.plans.demand_oracle import DAILY, GRID, LINES, SEGMENTS, r, with_

SQL: dict[str, str] = {}


def _words(ws: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in ws)


EVENTS = f"""
worded AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id AS sku, user_id % 4 AS site, value AS qty,
         CASE event_type WHEN 'signup' THEN 'Reception ' WHEN 'click' THEN 'IN' WHEN 'purchase' THEN 'Sortie'
                         WHEN 'view' THEN ' outgoing' ELSE event_type END AS flow_word FROM events),
ev AS (
  SELECT *, CASE WHEN lower(trim(flow_word)) IN ({_words(L.IN_WORDS)}) THEN 'in'
                 WHEN lower(trim(flow_word)) IN ({_words(L.OUT_WORDS)}) THEN 'out' ELSE 'unknown' END AS direction
  FROM worded)"""


def slots(table: str = "supplier", key: str = "s_suppkey") -> str:
    return f"""
slots AS (
  SELECT {key} AS slot_id, {key} % 4 AS site, {key} % 20 AS x, ({key} // 100) % 10 AS y, ({key} // 20) % 5 AS z,
         'S-' || ({key} % 20) || '-' || (({key} // 100) % 10) || '-' || (({key} // 20) % 5) || '-' || {key} AS code,
         CASE ({key} // 20) % 5 WHEN 0 THEN 'B7-PCK' WHEN 4 THEN 'B07-SS' ELSE 'B07-N' || (({key} // 20) % 5) END AS zone,
         'C' || ({key} % 20) AS floor, CASE WHEN ({key} // 20) % 5 = 0 THEN 'PICKING' ELSE 'RESERVE' END AS slot_type,
         CAST(abs({key} % 20 - 3) + abs(({key} // 100) % 10 - 5) + ({key} // 20) % 5 AS DOUBLE) AS dist
  FROM {table})"""


CUSTOMER_SLOTS = slots("customer", "c_custkey")


def ledger(source: str, keys: str, name: str) -> str:
    """CTEs that end in ``name``: source plus ok, held, fifo_no."""
    order = f"(PARTITION BY {keys} ORDER BY ts, event_id"
    return f"""
{name}_net AS (
  SELECT *, sum(CASE direction WHEN 'in' THEN 1 WHEN 'out' THEN -1 ELSE 0 END) OVER {order}) AS net,
         sum(CASE direction WHEN 'in' THEN 1 ELSE 0 END) OVER {order}) AS ins FROM {source}),
{name}_low AS (
  SELECT *, least(0, coalesce(min(net) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low
  FROM {name}_net),
{name}_held AS (
  SELECT *, CASE direction WHEN 'in' THEN true WHEN 'out' THEN net >= low ELSE false END AS ok,
         CAST(net - least(low, net) AS BIGINT) AS held FROM {name}_low),
{name} AS (
  SELECT * EXCLUDE (net, low), CAST(CASE WHEN direction = 'in' THEN ins WHEN ok THEN ins - held END AS BIGINT) AS fifo_no
  FROM {name}_held)"""


WHOLE = (EVENTS, ledger("ev", "site, sku", "led"))
SQL["flow_canonical"] = f"{with_(EVENTS)} SELECT event_id, flow_word, direction FROM ev"
SQL["flow_counts"] = f"{with_(EVENTS)} SELECT direction, count(*) AS n FROM ev GROUP BY direction"
SQL["coerced_events"] = """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
       CAST(coalesce(TRY_CAST(event_type AS DOUBLE), -1) AS BIGINT) AS type_no FROM events"""
SQL["slot_counts"] = f"""{with_(CUSTOMER_SLOTS)}
SELECT 'slot_type' AS field, slot_type AS value, count(*) AS n FROM slots GROUP BY slot_type UNION ALL
SELECT 'zone', zone, count(*) FROM slots GROUP BY zone UNION ALL
SELECT 'z', CAST(z AS VARCHAR), count(*) FROM slots GROUP BY z"""
SQL["stock_ledger"] = f"{with_(*WHOLE)} SELECT event_id, site, sku, direction, ok, held, fifo_no FROM led"
SQL["fifo_match"] = f"""{with_(*WHOLE)}
SELECT i.site, i.sku, i.fifo_no, i.event_id AS in_event, o.event_id AS out_event
FROM led i JOIN led o ON i.site = o.site AND i.sku = o.sku AND i.fifo_no = o.fifo_no
WHERE i.direction = 'in' AND o.direction = 'out' AND o.ok"""
STOCK = """
stock AS (
  SELECT i.* FROM led i WHERE direction = 'in' AND NOT EXISTS (
    SELECT 1 FROM led o WHERE o.direction = 'out' AND o.ok AND o.site = i.site AND o.sku = i.sku AND o.fifo_no = i.fifo_no))"""
SQL["current_stock"] = f"""{with_(*WHOLE, STOCK)}
SELECT site, sku, count(*) AS slots_held, min(fifo_no) AS oldest_no, {r('sum(qty)', 'qty', 2)} FROM stock GROUP BY site, sku"""
SQL["site_load"] = f"""{with_(*WHOLE, slots())},
n AS (SELECT site, count(*) AS site_slots FROM slots GROUP BY site),
l AS (
  SELECT event_id, site, CAST(sum(CASE WHEN NOT ok THEN 0 WHEN direction = 'in' THEN 1 ELSE -1 END)
         OVER (PARTITION BY site ORDER BY ts, event_id) AS BIGINT) AS site_held FROM led)
SELECT event_id, site, site_held, site_slots, site_held > coalesce(site_slots, 0) AS over_full FROM l LEFT JOIN n USING (site)"""

CLASS = (
    LINES,
    DAILY,
    GRID,
    SEGMENTS,
    """
freq AS (SELECT sku, avg(has_demand) AS demand_freq FROM grid GROUP BY sku),
product_class AS (
  SELECT sku, segment, demand_freq, CAST(p_size AS DOUBLE) / 5 AS weight_kg
  FROM segments JOIN freq USING (sku) LEFT JOIN part ON p_partkey = sku)""",
)


def classed(source: str) -> str:
    return f"""
classed AS (
  SELECT e.*, coalesce(segment, 'LF') AS segment, coalesce(demand_freq, 0) AS demand_freq, coalesce(weight_kg, 0) AS weight_kg,
         CASE WHEN segment = 'HF' AND demand_freq > 0.01 THEN 'PICKING' ELSE 'RESERVE' END AS target_type
  FROM {source} e LEFT JOIN product_class USING (sku))"""


def assign(arrivals: str, batch: str) -> str:
    """Own type first by rank; overflow takes what the other type leaves."""
    return f"""
ranked_slots AS (
  SELECT *, row_number() OVER (PARTITION BY site, slot_type
            ORDER BY CASE WHEN slot_type = 'PICKING' THEN 3 * dist + 5 * z ELSE dist + 2 * z END, slot_id) AS no FROM slots),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY {batch}, site, target_type ORDER BY ts, event_id) AS no FROM {arrivals}),
first_pass AS (
  SELECT q.*, s.slot_id FROM queue q LEFT JOIN ranked_slots s
  ON s.site = q.site AND s.slot_type = q.target_type AND s.no = q.no),
spill AS (
  SELECT *, row_number() OVER (PARTITION BY {batch}, site, target_type ORDER BY ts, event_id) AS spill_no
  FROM first_pass WHERE slot_id IS NULL),
leftover AS (
  SELECT b.{batch}, s.site, s.slot_type, s.slot_id,
         row_number() OVER (PARTITION BY b.{batch}, s.site, s.slot_type ORDER BY s.no) AS left_no
  FROM (SELECT DISTINCT {batch}, site FROM queue) b JOIN ranked_slots s ON s.site = b.site
  WHERE NOT EXISTS (SELECT 1 FROM first_pass f WHERE f.{batch} = b.{batch} AND f.slot_id = s.slot_id)),
assigned AS (
  SELECT f.* EXCLUDE (slot_id, no), coalesce(f.slot_id, l.slot_id) AS slot_id
  FROM first_pass f LEFT JOIN spill p ON p.event_id = f.event_id
  LEFT JOIN leftover l ON l.{batch} = p.{batch} AND l.site = p.site AND l.slot_type <> p.target_type AND l.left_no = p.spill_no)"""


PLAN = (
    *WHOLE, STOCK, *CLASS, "numbered_stock AS (SELECT *, 1 AS batch FROM stock)", classed("numbered_stock"), CUSTOMER_SLOTS,
    assign("classed", "batch"),
)
SQL["occupancy"] = f"""{with_(*PLAN)}
SELECT coalesce(slot_type, 'ALL') AS slot_type, count(*) AS total, count(a.slot_id) AS occupied,
       count(*) - count(a.slot_id) AS available, round_even(count(a.slot_id) / count(*) * 100, 1) AS occupancy_rate
FROM slots s LEFT JOIN (SELECT DISTINCT slot_id FROM assigned) a ON a.slot_id = s.slot_id GROUP BY ROLLUP (slot_type)"""
SQL["free_slots"] = f"""{with_(*PLAN)}
SELECT slot_id, site, code, dist FROM slots WHERE slot_type = 'PICKING'
AND slot_id NOT IN (SELECT slot_id FROM assigned WHERE slot_id IS NOT NULL)"""
SQL["slot_scores_topk"] = f"""{with_(CUSTOMER_SLOTS)},
classes AS (SELECT * FROM (VALUES ('HF', false), ('HF', true), ('LF', false), ('LF', true)) AS t(segment, heavy)),
scored AS (
  SELECT site, slot_type, segment, heavy, slot_id,
         CASE WHEN segment = 'HF' THEN -3.0 * dist - 5.0 * z ELSE -dist - 2.0 * z END
         - CASE WHEN heavy THEN 10.0 * z ELSE 0 END AS score FROM slots CROSS JOIN classes),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site, slot_type, segment, heavy ORDER BY score DESC, slot_id) AS pos FROM scored)
SELECT site, slot_type, segment, heavy, pos, slot_id, CAST(score AS DOUBLE) AS score FROM ranked WHERE pos <= 5"""

_AISLE = "'Allee ' || floor"
_KIND = "CASE WHEN contains(zone, 'PCK') THEN ' -> (zone picking)' ELSE ' -> (zone reserve)' END"


def route(start: str = "0", z: str = "z") -> str:
    return f"""CASE WHEN {z} > {start} THEN 'Monter au niveau ' || {z} || ' via lift -> '
                    WHEN {z} < {start} THEN 'Descendre au niveau ' || {z} || ' via lift -> ' ELSE '' END
               || {_AISLE} || ' -> Se rendre a ' || code || {_KIND}"""


RECEIPT = f"'Reception -> ' || {route()}"
EXPEDITION = f"'Expedition -> ' || {route()} || ' -> Retour Expedition'"
SHORT_IN = """CASE WHEN contains(zone, 'PCK') THEN 'Reception -> Zone Picking B7 -> ' || code
  WHEN contains(zone, 'B07-N') THEN 'Reception -> Lift -> ' || replace(zone, 'B07-', '') || ' -> ' || code
  ELSE 'Reception -> Lift -> Sous-sol -> ' || code END"""
SHORT_OUT = """CASE WHEN contains(zone, 'PCK') THEN code || ' -> Zone Picking B7 -> Expedition'
  WHEN contains(zone, 'B07-N') THEN code || ' -> ' || replace(zone, 'B07-', '') || ' -> Lift -> Expedition'
  ELSE code || ' -> Sous-sol -> Lift -> Expedition' END"""
SQL["slot_labels"] = f"""{with_(CUSTOMER_SLOTS)}
SELECT slot_id, CASE WHEN zone = 'B7-PCK' THEN 'Zone Picking B7' WHEN zone = 'B07-SS' THEN 'Zone Sous-sol Reserve'
                     ELSE 'Zone Reserve ' || substr(zone, 5) END || ' -> Allee ' || substr(floor, 1, 2) || ' -> '
       || CASE WHEN z > 0 THEN 'Etage ' || z || ' (acces lift)' ELSE 'RDC' END || ' -> Emplacement ' || code AS label,
       {RECEIPT} AS receipt, {EXPEDITION} AS expedition, {SHORT_IN} AS short_in, {SHORT_OUT} AS short_out FROM slots"""

DAY_PLAN = (EVENTS, *CLASS, classed("ev"), slots(), "arrivals AS (SELECT * FROM classed WHERE direction = 'in')", assign("arrivals", "day"))
SQL["slot_assignment"] = f"""{with_(*DAY_PLAN)}
SELECT event_id, day, a.site, target_type, a.slot_id, slot_type FROM assigned a LEFT JOIN slots s ON s.slot_id = a.slot_id"""
BOOKED = (
    *DAY_PLAN,
    """
placed AS (
  SELECT c.* EXCLUDE (direction), c.direction AS way, a.slot_id AS in_slot,
         CASE WHEN c.direction = 'in' AND a.slot_id IS NULL THEN 'unplaced' ELSE c.direction END AS direction
  FROM classed c LEFT JOIN assigned a ON a.event_id = c.event_id)""",
    ledger("placed", "day, site, sku", "bl"),
    """
booked AS (
  SELECT b.* EXCLUDE (site), b.site, s.* EXCLUDE (site) FROM (
    SELECT o.*, CASE o.way WHEN 'in' THEN o.in_slot ELSE i.in_slot END AS chosen
    FROM bl o LEFT JOIN bl i ON o.way = 'out' AND o.ok AND i.direction = 'in' AND i.day = o.day AND i.site = o.site
                                AND i.sku = o.sku AND i.fifo_no = o.fifo_no) b
  LEFT JOIN slots s ON s.slot_id = b.chosen)""",
)
_lift = "slot_id IS NOT NULL"
SQL["event_outcomes"] = f"""{with_(*BOOKED)}, average AS (SELECT sku, avg(demand) AS a FROM daily GROUP BY sku)
SELECT event_id, day, sku, site, way AS direction, qty,
  CASE WHEN way = 'in' AND {_lift} THEN 'Reception -> Stockage en ' || code
       WHEN way = 'in' THEN '{L.NO_SLOT_ACTION.replace("'", "''")}'
       WHEN way = 'out' AND {_lift} THEN 'Picking depuis ' || code || ' -> Expedition'
       WHEN way = 'out' THEN '{L.STOCK_OUT_ACTION}' ELSE '{L.UNKNOWN_ACTION}' END AS action,
  slot_id, code, zone,
  CASE WHEN way = 'in' AND {_lift} THEN {RECEIPT} WHEN way = 'out' AND {_lift} THEN {EXPEDITION} END AS route,
  CASE WHEN {_lift} THEN CAST(greatest(1, ceil(coalesce(nullif(weight_kg, 0), 0.5) * qty / 300.0)) AS BIGINT) END AS trips,
  CASE WHEN way = 'in' AND {_lift} THEN 'Segment=' || segment || '; Freq=' || printf('%.4f', CAST(demand_freq AS DOUBLE)) || '; Type=' || slot_type
            || '; Dist exp=' || CAST(dist AS VARCHAR) || '; Etage=' || z
            || CASE WHEN weight_kg > 5 THEN '; Lourd (' || CAST(CAST(weight_kg AS DOUBLE) AS VARCHAR) || 'kg) -> sol' ELSE '' END
       WHEN way = 'in' THEN '{L.NO_SLOT_REASON}'
       WHEN way = 'out' AND {_lift} THEN 'Produit trouve en ' || code || ' (segment=' || segment || ', freq=' || printf('%.4f', CAST(demand_freq AS DOUBLE)) || ')'
       WHEN way = 'out' THEN 'Aucun emplacement trouve pour produit ' || sku || '. Verifier approvisionnements.' END AS reason,
  CASE WHEN way <> 'unknown' THEN {r('a', 'x', 2).split(' AS ')[0]} END AS forecast_demand,
  {_lift} AS success,
  CASE WHEN way = 'in' AND NOT ({_lift}) THEN '{L.NO_SLOT_WARNING}' WHEN way = 'out' AND NOT ({_lift}) THEN '{L.STOCK_OUT_WARNING}'
       WHEN way = 'unknown' THEN 'flow_type doit etre ''ingoing'' ou ''outgoing'', recu: ''' || lower(flow_word) || ''''
       ELSE '' END AS warning
FROM booked LEFT JOIN average USING (sku)"""
INSTRUCTIONS = f"""
instr AS (
  SELECT event_id, day, sku AS Product, CASE way WHEN 'in' THEN 'Storage' WHEN 'out' THEN 'Picking' ELSE 'Unknown' END AS Action,
    coalesce(code, 'N/A') AS Location,
    CASE WHEN slot_id IS NULL THEN 'N/A' WHEN way = 'in' THEN {SHORT_IN} ELSE {SHORT_OUT} END AS Route,
    CASE WHEN way = 'in' AND {_lift} AND segment = 'HF' THEN 'Segment=HF; High freq (' || printf('%.3f', CAST(demand_freq AS DOUBLE)) || '); Min distance to expedition'
         WHEN way = 'in' AND {_lift} THEN 'Segment=LF; Low freq (' || printf('%.4f', CAST(demand_freq AS DOUBLE)) || '); Reserve storage'
         WHEN way = 'in' THEN 'No available slots'
         WHEN way = 'out' AND {_lift} THEN CASE WHEN segment = 'HF' THEN 'High demand product' ELSE 'Low frequency product' END
              || '; Freq=' || printf('%.4f', CAST(demand_freq AS DOUBLE))
         WHEN way = 'out' THEN 'Product ' || sku || ' not in stock - stockout'
         ELSE 'Unknown flow type: ' || lower(trim(flow_word)) END AS Reason
  FROM booked)"""
SQL["instructions"] = f"{with_(*BOOKED, INSTRUCTIONS)} SELECT * FROM instr"
SQL["instruction_summary"] = f"""{with_(*BOOKED, INSTRUCTIONS)}
SELECT count(*) AS events, count(*) FILTER (Action = 'Storage') AS storages, count(*) FILTER (Action = 'Picking') AS pickings,
       count(*) FILTER (contains(Location, 'N/A')) AS failures FROM instr"""
SQL["congestion_log"] = f"""{with_(*BOOKED)},
m AS (
  SELECT event_id, day, zone, row_number() OVER (PARTITION BY day, zone ORDER BY ts, event_id) AS n_moves
  FROM booked WHERE way = 'out' AND {_lift})
SELECT event_id, day, zone, n_moves,
       CAST(day AS VARCHAR) || ': Zone ' || zone || ' - ' || n_moves || ' mouvements, congestion possible' AS warning
FROM m WHERE n_moves > 5"""
SQL["daily_congestion"] = f"""{with_(EVENTS, CUSTOMER_SLOTS)},
m AS (
  SELECT event_id, day, zone, row_number() OVER (PARTITION BY day, zone ORDER BY ts, event_id) AS n_moves
  FROM ev JOIN slots ON slot_id = sku WHERE direction <> 'unknown')
SELECT * FROM m WHERE n_moves > 5"""
SQL["daily_occupancy"] = f"""{with_(*BOOKED)},
occupied AS (
  SELECT day, slot_id, slot_type FROM booked b WHERE way = 'in' AND {_lift} AND NOT EXISTS (
    SELECT 1 FROM booked o WHERE o.way = 'out' AND o.day = b.day AND o.slot_id = b.slot_id)),
kinds AS (SELECT * FROM (VALUES ('PICKING'), ('RESERVE'), ('ALL')) AS t(kind)),
sizes AS (SELECT kind, count(slot_id) AS total FROM kinds LEFT JOIN slots ON kind IN (slot_type, 'ALL') GROUP BY kind),
c AS (
  SELECT d.day, kind AS slot_type, total, (SELECT count(*) FROM occupied o WHERE o.day = d.day AND kind IN (o.slot_type, 'ALL')) AS occupied
  FROM (SELECT DISTINCT day FROM occupied) d CROSS JOIN sizes)
SELECT *, total - occupied AS available,
       CASE WHEN total > 0 THEN round_even(occupied / total * 100, 1) ELSE 0 END AS occupancy_rate FROM c"""

# ------------------------------------------------------------------- picking

ITEMS = """
items AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS sku, l_suppkey AS slot_id, l_quantity AS qty,
         CAST(p_size AS DOUBLE) / 5 AS weight_kg,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS item_no,
         CAST(round(coalesce(CAST(p_size AS DOUBLE) / 5, 0.5) * l_quantity * 1000) AS BIGINT) AS grams
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
SPLIT = """
split AS (
  SELECT order_id, item_no, sku, slot_id, grams, 1 AS chariot, grams AS load FROM items WHERE item_no = 1
  UNION ALL
  SELECT i.order_id, i.item_no, i.sku, i.slot_id, i.grams,
         CASE WHEN s.load + i.grams > 300000 AND s.chariot < 3 THEN s.chariot + 1 ELSE s.chariot END,
         CASE WHEN s.load + i.grams > 300000 AND s.chariot < 3 THEN i.grams ELSE s.load + i.grams END
  FROM split s JOIN items i ON i.order_id = s.order_id AND i.item_no = s.item_no + 1)"""
TOUR = """
located AS (SELECT * FROM split JOIN slots USING (slot_id)),
walk AS (
  SELECT order_id, chariot, 0 AS step, 3 AS x, 5 AS y, 0 AS z, 0 AS from_z, CAST(NULL AS BIGINT) AS item_no, 0 AS dist,
         list({'n': item_no, 'x': x, 'y': y, 'z': z}) AS remaining
  FROM located GROUP BY order_id, chariot
  UNION ALL
  SELECT order_id, chariot, step + 1, best.x, best.y, best.z, z, best.n, best.d,
         list_filter(remaining, lambda p: p.n <> best.n)
  FROM (
    SELECT *, list_sort(list_transform(remaining, lambda p: {
      'd': abs(p.x - x) + abs(p.y - y) + abs(p.z - z), 'n': p.n, 'x': p.x, 'y': p.y, 'z': p.z}))[1] AS best
    FROM walk WHERE len(remaining) > 0)),
steps AS (
  SELECT w.order_id, w.chariot, w.step, 'pick' AS action, l.sku, l.code, l.zone, l.floor, l.z AS level, from_z,
         CAST(w.dist AS DOUBLE) AS distance, l.grams / 1000.0 AS kg
  FROM walk w JOIN located l ON l.order_id = w.order_id AND l.item_no = w.item_no
  UNION ALL
  SELECT order_id, chariot, step + 1, 'return', NULL, 'EXPEDITION', 'B7-N0', NULL, 0, z,
         CAST(abs(x - 3) + abs(y - 5) + z AS DOUBLE), NULL FROM walk WHERE len(remaining) = 0)"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


# a given slot of 0 is missing; then the product's first stored slot, then the first PICKING slot
RESOLVED = """
oldest AS (SELECT sku, arg_min(event_id, fifo_no) % 50 AS stored_slot FROM stock GROUP BY sku),
items AS (
  SELECT l.* REPLACE (coalesce(nullif(l.slot_id, 0), stored_slot, (SELECT min(slot_id) FROM slots WHERE slot_type = 'PICKING'), 0) AS slot_id)
  FROM lines_to_pick l LEFT JOIN oldest USING (sku))"""
ROUTED = (*WHOLE, STOCK, slots(), ITEMS.replace("items AS (", "lines_to_pick AS (", 1), RESOLVED)
SQL["chariot_split"] = f"""{recursive(*ROUTED, SPLIT)}
SELECT order_id, item_no, sku, slot_id, grams, CAST(chariot AS BIGINT) AS chariot FROM split"""
TOURS = recursive(*ROUTED, SPLIT, TOUR)
SQL["pick_tours"] = f"""{TOURS}
SELECT order_id, CAST(chariot AS BIGINT) AS chariot, CAST(step AS BIGINT) AS step, action, sku, code, distance,
       CASE WHEN action = 'return' THEN 'Retour zone expedition' ELSE {route('from_z', 'level')} END AS detail FROM steps"""
SQL["chariot_totals"] = f"""{TOURS}
SELECT order_id, CAST(chariot AS BIGINT) AS chariot, count(sku) AS items, sum(distance) AS distance,
       round_even(CAST(sum(kg) AS DOUBLE), 1) AS weight_kg FROM steps GROUP BY order_id, chariot"""
SQL["tour_totals"] = f"""{TOURS}
SELECT order_id, CAST(max(chariot) AS BIGINT) AS chariots, count(sku) AS items, sum(distance) AS distance,
       {r('(count(sku) * 16 - sum(distance)) / (count(sku) * 16) * 100', 'efficiency_pct')} FROM steps GROUP BY order_id"""
SQL["zone_congestion"] = f"""{TOURS}
SELECT order_id, zone, CAST(level AS BIGINT) AS level, count(*) AS picks FROM steps WHERE action = 'pick'
GROUP BY order_id, zone, level HAVING count(*) > 3"""
SQL["nested_tours"] = f"""{TOURS},
moves AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz FROM walk
          WINDOW o AS (PARTITION BY order_id, chariot ORDER BY step))
SELECT order_id, CAST(chariot AS BIGINT) AS chariot, string_agg(x || ',' || y || ',' || z, ' ' ORDER BY step) AS path,
       CAST(sum(dist) AS BIGINT) AS distance_out
FROM moves WHERE step = 1 OR (step > 1 AND (x, y, z) IS DISTINCT FROM (px, py, pz)) GROUP BY order_id, chariot"""
SQL["chariot_trips"] = f"""{with_(ITEMS)}
SELECT CAST(greatest(1, ceil(coalesce(nullif(weight_kg, 0), 0.5) * qty / 300.0)) AS BIGINT) AS trips, count(*) AS n
FROM items GROUP BY 1"""
SQL["location_fallback"] = f"""{with_(*WHOLE, STOCK, slots(), ITEMS)},
oldest AS (SELECT sku, arg_min(event_id, fifo_no) % 50 AS stored_slot FROM stock GROUP BY sku),
resolved AS (
  SELECT i.sku, coalesce(nullif(i.slot_id, 0), stored_slot, (SELECT min(slot_id) FROM slots WHERE slot_type = 'PICKING'), 0) AS slot_id
  FROM items i LEFT JOIN oldest USING (sku))
SELECT r.sku, r.slot_id, s.slot_id IS NOT NULL AS known, count(*) AS n
FROM resolved r LEFT JOIN slots s ON s.slot_id = r.slot_id GROUP BY ALL"""
