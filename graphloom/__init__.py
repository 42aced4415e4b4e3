"""graphloom: property-graph and ranked-retrieval analytics as Spark plans."""
