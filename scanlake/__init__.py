"""LiDAR-log and trajectory analytics as PySpark DataFrame operators."""
