"""Tabula: typed tables, graphs and analytics as Spark DataFrame programs."""
