"""strata: a Spark-native engine for layout-structured, versioned documents."""
