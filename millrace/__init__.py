"""millrace: path, secret and crawl analysis of fetched web content on Spark."""
