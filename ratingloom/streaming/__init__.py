"""ratingloom.streaming"""
