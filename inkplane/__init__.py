"""Character-detection data preparation as Spark DataFrame operators."""
