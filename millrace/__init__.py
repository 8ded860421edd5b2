"""millrace: curation and analytics of mixed text, sensor and trajectory data on Spark."""
