"""Frame analytics, watermark evidence and corpus operators as Spark plans."""
