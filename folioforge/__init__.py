"""Bibliographic search and mining on Spark."""
