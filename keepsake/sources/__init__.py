"""Export formats: files to event rows."""
