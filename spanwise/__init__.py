"""Set-wise analytics for attention profiles, timed text and the records around them, on PySpark."""
