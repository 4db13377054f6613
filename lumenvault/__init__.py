"""lumenvault: media-catalogue analytics as Spark DataFrame jobs."""
