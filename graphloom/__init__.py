"""graphloom: Spark-native analytics over typed, evidence-labelled graphs."""

__version__ = "0.1.0"
