"""Tessera: a Spark-first engine for measure -> decide -> review workflows over tables."""
