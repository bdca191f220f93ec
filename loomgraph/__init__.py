"""A property-graph engine on Spark: GQL and SPARQL queries compiled to DataFrames."""
