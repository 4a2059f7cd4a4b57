"""tidemill: a PySpark-native analytics engine for file, media and text inventories."""

__version__ = "0.1.0"
