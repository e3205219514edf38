"""Settlement reconciliation and corpus analytics expressed as Spark DataFrame jobs."""
