"""Forecast analytics on Spark: scoring probability forecasts against a market price and the outcome."""
