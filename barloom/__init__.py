"""Rule-based trading-strategy tests over price-bar tables, as Spark DataFrame jobs."""
