"""News and deal intelligence jobs on Spark tables and streams."""
