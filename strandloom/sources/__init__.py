"""strandloom.sources"""
