"""casework: Spark jobs over digital-forensic evidence packages."""
