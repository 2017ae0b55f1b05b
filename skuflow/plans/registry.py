"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from skuflow.plans import boosted_queries, demand_oracle, demand_queries, file_oracle, file_queries, model_oracle, model_queries, warehouse_oracle, warehouse_queries

QUERIES = {**demand_queries.QUERIES, **warehouse_queries.QUERIES, **model_queries.QUERIES, **boosted_queries.QUERIES, **file_queries.QUERIES}
ORACLE = {**demand_oracle.SQL, **warehouse_oracle.SQL, **model_oracle.SQL, **file_oracle.SQL}
