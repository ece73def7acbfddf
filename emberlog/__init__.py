"""Security-event analytics on Spark: parsing, correlation, rules, alerts and their reports."""
