"""Subscriber retention analytics as Spark DataFrame operators."""
