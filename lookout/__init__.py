"""lookout: early-warning analytics over per-subject records, text and signals, on Spark."""
