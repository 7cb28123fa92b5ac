"""Classical data mining on labelled tables, expressed as Spark DataFrame jobs."""
