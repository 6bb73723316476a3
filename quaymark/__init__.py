"""Market and lending analytics as DataFrame-to-DataFrame operators on Spark."""
