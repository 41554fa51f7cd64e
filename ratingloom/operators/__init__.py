"""ratingloom.operators"""
