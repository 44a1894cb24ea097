"""Listening analytics and recommendations as Spark DataFrame operators."""
