"""tracegrid: chart digitising and corpus preparation as Spark DataFrame operators."""
