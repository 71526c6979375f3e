"""strandloom.operators"""
