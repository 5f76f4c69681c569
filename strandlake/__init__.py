"""Set-at-a-time analytics over sequencing reads, written as Spark DataFrame plans."""
