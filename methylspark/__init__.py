"""PySpark-native analytics for DNA-methylation sequencing data."""

__version__ = "0.3"
