"""Security-event analytics as chainable PySpark DataFrame operators."""
