"""Tessera: a PySpark-native analytics engine for agent session logs and knowledge records."""
