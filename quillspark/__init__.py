"""quillspark: document-evidence tables and corpus preparation as Spark jobs."""
