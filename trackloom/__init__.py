"""Track-fusion analytics as Spark plans."""
