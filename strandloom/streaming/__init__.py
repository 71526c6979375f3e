"""strandloom.streaming"""
