"""strandloom: repeat discovery, interval scoring and block graphs as Spark DataFrame plans."""
