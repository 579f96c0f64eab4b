"""Value-transfer and network forensics on Spark."""
