"""Condition monitoring of motors on Spark: windows, rules, alerts and run statistics."""
