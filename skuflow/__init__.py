"""Demand forecasting and warehouse-flow analytics, written as Spark jobs."""
