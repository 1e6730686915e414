"""quillstrand: evaluation of symbolic sequences, expressed as Spark DataFrame plans."""
