"""Fleet fuel, emission and carbon-cost analytics on PySpark."""
