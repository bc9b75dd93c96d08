"""cellmill: a Spark-first engine that turns evaluation samples into cells, scores and statistics."""
