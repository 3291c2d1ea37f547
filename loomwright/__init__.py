"""loomwright: a PySpark-native engine for curating, auditing and evaluating code- and text-repair datasets."""

__version__ = "0.1.0"
