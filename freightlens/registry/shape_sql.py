"""SQL twins of the derived shapes, added in front of an oracle statement that names them."""

from __future__ import annotations

import re

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

SHAPES = {
    "readings": f"""
  SELECT event_id AS id, 'Truck_' || CAST(user_id % 10 + 1 AS VARCHAR) AS asset_id, ts,
    CASE event_type WHEN 'purchase' THEN 'Delivered' WHEN 'error' THEN 'Delayed'
      WHEN 'signup' THEN 'Pending' ELSE 'In Transit' END AS shipment_status,
    CASE k % 3 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Heavy' ELSE 'Detour' END AS traffic_status,
    k % 61 AS waiting_time,
    logistics_delay,
    CASE WHEN NOT logistics_delay THEN 'None' WHEN k % 4 = 0 THEN 'Weather' WHEN k % 4 = 1 THEN 'Traffic'
      WHEN k % 4 = 2 THEN 'Mechanical Failure' ELSE 'None' END AS logistics_delay_reason,
    CAST(event_id * 7919 % 18001 AS DOUBLE) / 100 - 90 AS latitude,
    CAST(event_id * 104729 % 36001 AS DOUBLE) / 100 - 180 AS longitude,
    CAST(100 + event_id % 400 AS INTEGER) AS inventory_level,
    CASE WHEN event_id % 17 <> 0 THEN CAST(18 + event_id % 13 AS DOUBLE) END AS temperature,
    CASE WHEN event_id % 19 <> 0 THEN CAST(50 + event_id % 31 AS DOUBLE) END AS humidity,
    value AS user_transaction_amount,
    CAST(1 + event_id % 10 AS INTEGER) AS user_purchase_frequency,
    CAST(60 + event_id % 41 AS DOUBLE) AS asset_utilization,
    CAST(100 + event_id % 201 AS DOUBLE) AS demand_forecast,
    event_id % 50 <> 0 AS is_active
  FROM (SELECT *, event_type = 'error' OR (k % 3 = 1 AND k % 61 > 30) AS logistics_delay
        FROM (SELECT *, {_K} AS k FROM events))""",
    "scored": """
  SELECT *, least(1e0, 0.3e0 + CASE WHEN traffic_status = 'Heavy' THEN 0.3e0 ELSE 0e0 END
    + CASE WHEN waiting_time > 30 THEN 0.2e0 ELSE 0e0 END
    + CASE WHEN logistics_delay_reason IS DISTINCT FROM 'None' THEN 0.2e0 ELSE 0e0 END) AS delay_probability
  FROM readings""",
    "daily": """
  SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) FILTER (logistics_delay) AS delayed,
    avg(delay_probability) AS prob, avg(waiting_time) AS wait,
    100e0 * count(*) FILTER (logistics_delay) / count(*) AS rate
  FROM scored GROUP BY 1""",
    "ports": """
  SELECT n_nationkey AS port_key, r_name || '_' || CAST(n_nationkey AS VARCHAR) AS port
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "voyages": """
  SELECT o_orderkey AS id, 'SHP' || CAST(1000 + o_orderkey AS VARCHAR) AS shipment_id, o_custkey AS customer_id,
    po.port AS origin_port, pd.port AS destination_port, po.port || '-' || pd.port AS route,
    CASE o_orderkey % 4 WHEN 0 THEN '20GP' WHEN 1 THEN '40GP' WHEN 2 THEN '40HC' ELSE '45HC' END AS container_type,
    o_totalprice / 10 AS cargo_weight, o_totalprice AS cargo_value,
    CASE o_orderkey % 3 WHEN 0 THEN 'electronics' WHEN 1 THEN 'textiles' ELSE 'machinery' END AS cargo_type,
    o_orderdate AS scheduled_departure, sa AS scheduled_arrival,
    CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 3 = 0)
      THEN sa + to_hours((o_orderkey * 31 % 97) - 24) END AS actual_arrival,
    CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'delayed'
      WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'in_transit' END AS status,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_priority, o_orderdate AS created_at
  FROM (SELECT *, o_orderdate + to_days(CAST(7 + o_orderkey % 15 AS INTEGER)) AS sa FROM orders) o
  JOIN customer ON o_custkey = c_custkey
  JOIN ports po ON po.port_key = c_nationkey
  JOIN ports pd ON pd.port_key = (c_nationkey + 1 + o_orderkey % 5) % 25""",
    "customers": """
  SELECT c_custkey AS id, c_name AS name, 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
    CASE WHEN c_custkey % 7 <> 0 THEN '+1-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone,
    'Company ' || CAST(c_custkey % 10 AS VARCHAR) AS company,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'sms' WHEN 'BUILDING' THEN 'phone'
      WHEN 'FURNITURE' THEN 'webhook' ELSE 'email' END AS preferred_communication,
    c_custkey % 20 <> 0 AS is_active
  FROM customer""",
    "predictions": """
  SELECT l_orderkey AS shipment_id, l_linenumber, l_partkey, l_suppkey, l_shipdate AS prediction_date,
    l_quantity AS predicted_delay_hours, least(l_quantity / 48, 1e0) AS delay_probability,
    1 - l_discount AS confidence_score,
    CASE l_returnflag WHEN 'A' THEN 'forest' WHEN 'N' THEN 'boosted' ELSE 'ensemble' END AS model_name,
    l_linestatus AS model_version, l_tax AS weather_factor,
    CASE WHEN l_linestatus = 'F' THEN greatest(CAST(l_orderkey * 31 % 97 - 24 AS DOUBLE), 0e0) END AS actual_delay_hours
  FROM lineitem""",
    "validated": """
  SELECT *, CASE WHEN actual_delay_hours > 0 THEN
      greatest(0e0, least(1e0, 1 - abs(predicted_delay_hours - actual_delay_hours)
        / greatest(predicted_delay_hours, actual_delay_hours, 1e0))) END AS prediction_accuracy
  FROM predictions""",
    "latest": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY prediction_date DESC, l_linenumber,
      l_partkey, l_suppkey, predicted_delay_hours, confidence_score) AS rn FROM predictions) WHERE rn = 1""",
    "communications": f"""
  SELECT event_id AS id, event_id // 4 AS shipment_id, user_id AS customer_id,
    CASE k % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' WHEN 2 THEN 'phone' ELSE 'webhook' END AS type, ts AS sent_at,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('purchase', 'click') THEN 'delivered'
      ELSE 'sent' END AS delivery_status,
    k % 10 <> 0 AS ai_generated, value / 500 AS engagement_score
  FROM (SELECT *, {_K} AS k FROM events)""",
    "tracking_events": """
  SELECT event_id AS id, event_id // 4 AS shipment_id,
    CASE event_type WHEN 'purchase' THEN 'arrived' WHEN 'click' THEN 'departed' WHEN 'error' THEN 'delayed'
      WHEN 'signup' THEN 'customs_cleared' ELSE 'in_transit' END AS event_type,
    ts AS event_timestamp, props AS event_data
  FROM events""",
    "external_data": """
  SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'weather' ELSE 'port_status' END AS data_type,
    CAST(user_id % 25 AS VARCHAR) AS data_key, value AS data_value, ts AS created_at,
    ts + INTERVAL 1 HOUR AS expires_at
  FROM events""",
}

_NEEDS = {
    "scored": ["readings"],
    "daily": ["readings", "scored"],
    "voyages": ["ports"],
    "validated": ["predictions"],
    "latest": ["predictions"],
}


def with_shapes(sql: str) -> str:
    """Prefix the CTEs of every shape the statement names, in definition order."""
    words = set(re.findall(r"\b\w+\b", sql))
    wanted = {name for name in SHAPES if name in words}
    for name in list(wanted):
        wanted.update(_NEEDS.get(name, []))
    ctes = [f"{name} AS ({SHAPES[name]})" for name in SHAPES if name in wanted]
    body = sql.strip()
    if not ctes:
        return body
    prefix = "WITH " + ",\n".join(ctes)
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + prefix[5:] + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return prefix + ",\n" + body[5:]
    return prefix + "\n" + body
