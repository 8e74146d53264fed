"""noteskein: notes to property graph, as Spark DataFrame operators."""
