"""skein: ragged, nested and nullable analytics as Spark DataFrame plans."""
