"""tracelode: a PySpark-native engine for phone-sensor, log, survey and text data."""

__version__ = "0.1.0"
