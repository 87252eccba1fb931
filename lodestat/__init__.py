"""Statistical data engine on PySpark: versioned tables, cleaning operators, profiling and analyses."""
