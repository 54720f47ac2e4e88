"""tidewell: batch hybrid document retrieval expressed as Spark DataFrame plans."""
