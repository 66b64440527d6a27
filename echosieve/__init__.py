"""Spark-native analytics over file inventories, fingerprints and catalogues."""
