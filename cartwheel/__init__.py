"""cartwheel: session-recommendation analytics expressed as Spark DataFrame plans."""
