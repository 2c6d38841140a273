"""Comment analytics about named people, as composable PySpark DataFrame transformations."""
