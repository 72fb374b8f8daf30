"""rivulet: name matching, ranking and assignment as Spark DataFrame plans."""
