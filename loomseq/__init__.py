"""loomseq: bioinformatics analytics as Spark DataFrame operators."""
