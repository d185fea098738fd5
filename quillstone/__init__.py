"""quillstone: evidence search, claim checking and corpus preparation as Spark DataFrame plans."""
