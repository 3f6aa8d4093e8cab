"""Source-code corpus analytics as ordinary Spark plans."""
