"""tonearm: a PySpark-native engine for sampled signals and the catalogue data around them."""
