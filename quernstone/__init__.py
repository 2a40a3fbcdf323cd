"""Quernstone: a Spark-first engine for data mining over tables, text, graphs and streams."""
