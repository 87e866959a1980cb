"""factloom: a Spark engine that turns positioned words of financial reports into proved facts."""
