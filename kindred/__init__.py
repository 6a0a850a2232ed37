"""Find groups and look-alikes in large observation tables with Spark."""
