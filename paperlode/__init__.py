"""Document retrieval, question answering analytics and data repair as Spark DataFrame jobs."""
