"""fluxpanel: panel and daily time-series analytics as Spark DataFrame operators."""
