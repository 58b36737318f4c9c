"""Readers and writers: BAM, BED, FASTA, whole-genome tiles."""
