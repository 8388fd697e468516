"""lumenarc: a Spark-native literature and corpus analytics engine."""
