"""kgloom: knowledge-graph integration and analytics as plain Spark plans."""
