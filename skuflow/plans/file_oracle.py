"""The file queries in SQL: what comes back is what the tables hold."""

from __future__ import annotations

from skuflow.plans import model_oracle
from skuflow.plans.demand_oracle import PART, r, with_
from skuflow.plans.file_queries import YEAR
from skuflow.plans.warehouse_oracle import BOOKED, INSTRUCTIONS

SQL: dict[str, str] = {}
SQL["keyed_parameters"] = """
SELECT p_partkey AS sku, p_type AS category, p_brand AS brand, CAST(p_size AS DOUBLE) / 5.0 AS weight_kg, p_retailprice AS price FROM part"""
SQL["mixed_event_files"] = model_oracle.SQL["event_file"]
SQL["instruction_file"] = f"""{with_(*BOOKED, INSTRUCTIONS)}
SELECT Product, Action, Location, Route, Reason, count(*) AS n FROM instr GROUP BY ALL"""
SQL["published_totals"] = f"""{with_(*PART)},
old AS (
  SELECT sku, sum(demand) AS t, count(*) AS n FROM daily, bounds WHERE datediff('day', day, d1) >= {YEAR} GROUP BY sku),
new AS (SELECT sku, sum(demand) AS t, count(*) AS n FROM daily GROUP BY sku)
SELECT sku, {r('new.t', 'total_demand')}, {r('old.t', 'total_before')}, new.n AS n_demand_days, old.n AS days_before
FROM new LEFT JOIN old USING (sku)"""
