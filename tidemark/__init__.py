"""Market-structure analytics as PySpark DataFrame transformations."""
