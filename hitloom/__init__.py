"""Web-access-log analytics on Spark: parse, star schema, reports, trusted ranges."""
