"""A PySpark engine that turns positioned text tokens into typed, validated field rows with their provenance."""
