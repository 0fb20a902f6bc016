"""Spark-native relationship analytics: triples, overlap graphs, identity, dependencies, clusters."""
