"""Operators that prepare a text corpus for training, each as Spark jobs over whole tables."""
