"""Log-evidence analytics as DataFrame-to-DataFrame operators on Spark."""
