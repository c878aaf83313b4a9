"""Queries over the driver's tables, each beside the SQL it must agree with."""
