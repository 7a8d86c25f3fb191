"""Analytics on sequencing reads and on text corpora, written for Spark."""
