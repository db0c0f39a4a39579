"""Session-bar analytics as Spark DataFrame transformations."""
