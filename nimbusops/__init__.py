"""nimbusops: disruption analytics on Spark (weather episodes and how operations respond)."""
