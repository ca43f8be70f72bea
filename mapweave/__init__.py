"""mapweave: a PySpark engine that turns a document collection with vectors into a labelled map."""
