"""knotwork: property-graph analytics (a Cypher dialect) and data operations on PySpark."""
