"""Trust-graph analytics and text-corpus processing on Spark."""
