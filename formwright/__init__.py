"""formwright: building shape to parcel function analytics as Spark plans."""
