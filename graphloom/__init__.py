"""Code-graph analytics on Spark: relations of a source-code knowledge graph and the operators over them."""
