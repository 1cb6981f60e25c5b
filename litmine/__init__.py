"""Mining of data-set mentions in scientific text and citation analytics, as Spark DataFrame jobs."""
