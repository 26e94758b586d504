"""tallyloom: scoring, pairing and auditing of structured extractions on PySpark."""
