"""Spark-native lexical analytics: extraction, normalization, layered merge, indexes, lookup, gates and keyed state."""
