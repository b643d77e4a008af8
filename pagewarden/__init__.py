"""Web-content quality analytics as Spark DataFrame operators."""
