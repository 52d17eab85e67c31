"""tallyforge: an evidence-governed analytics engine expressed as Spark plans."""
