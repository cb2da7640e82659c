"""Column-order analytics of large presence/absence matrices on Spark."""
