"""tessel: document retrieval, usage analytics and corpus preparation on Spark."""
