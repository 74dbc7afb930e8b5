"""Jobs: stored tables, views over the driver's tables, registered queries."""
