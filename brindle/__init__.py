"""Brindle: message-risk analytics as composable Spark DataFrame transformations."""
