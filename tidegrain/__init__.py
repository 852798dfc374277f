"""Spatio-temporal exposure linkage and corpus operators as Spark DataFrame plans."""
