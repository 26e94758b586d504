"""The durable journal as a structured stream, and labelled window extensions."""
