"""Engine facade, test graphs and the query catalog."""
