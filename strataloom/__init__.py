"""strataloom: document structuring and analytics as Spark DataFrame plans."""
