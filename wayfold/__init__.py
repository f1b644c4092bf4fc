"""wayfold: road-network reachability and routing over trajectory tables, on Spark.

Every job is a DataFrame plan: scans, filters, joins and aggregations are
built-in Spark operators; graph searches are a driver loop of DataFrame
joins and aggregations over all starts at once (see ``operators.frontier``).
"""

__all__ = ["session"]
