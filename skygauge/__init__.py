"""skygauge: environmental alert analytics as Spark DataFrame and streaming operators."""
