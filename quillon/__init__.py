"""quillon: ranked retrieval, decay, graph and activity analytics over memory tables on Apache Spark."""
