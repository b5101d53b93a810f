"""Business-document analytics on Spark: extraction, layout, validation and activity jobs as DataFrame operators."""
