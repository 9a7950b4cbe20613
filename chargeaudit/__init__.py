"""Table-scale auditing of medical bills and insurance claims with PySpark."""
