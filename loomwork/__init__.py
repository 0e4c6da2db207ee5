"""Spark jobs that learn from collections of data-science code and the tables it runs on."""
