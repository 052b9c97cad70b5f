"""Valid inference from a small labelled sample and a large set of predictions, as Spark aggregations."""
