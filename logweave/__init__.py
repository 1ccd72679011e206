"""PySpark jobs over corpora of assistant transcripts and training documents."""
