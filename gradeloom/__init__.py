"""gradeloom: assessment and knowledge-graph analytics as PySpark DataFrame operators."""
