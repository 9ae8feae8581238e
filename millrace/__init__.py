"""A Spark-native relational and array algebra with a fluent query builder."""
