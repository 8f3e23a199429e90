"""skein: a PySpark-native engine for building, auditing and scoring knowledge graphs over document collections."""

__version__ = "0.1.0"
