"""strandloom.functions"""
