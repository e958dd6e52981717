"""marlstone: a PySpark-native analytics engine for financial-research data."""
