"""strandloom.plans"""
