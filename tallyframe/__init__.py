"""Table operators, connectors and ready-made reports on PySpark DataFrames.

Every operator takes and returns a DataFrame and names its columns through
parameters. Nothing here runs a query of its own accord unless the docstring
says so; plans are left to Catalyst and adaptive execution.
"""
