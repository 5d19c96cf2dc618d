"""barloom: quantitative panel analytics as Spark DataFrame operators."""
