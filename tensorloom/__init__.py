"""tensorloom: tensor collections as Spark tables, queried with the DataFrame API."""
