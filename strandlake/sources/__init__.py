"""Data sources and writers for FASTQ, FASTA, SFF, adaptor and edge lists."""
