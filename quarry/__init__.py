"""Log evidence as Spark plans."""
