"""Point-in-time evidence analytics as Spark DataFrame plans."""
