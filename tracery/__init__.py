"""Retrieval, labelling and evaluation over tables, written as Spark DataFrame jobs."""
