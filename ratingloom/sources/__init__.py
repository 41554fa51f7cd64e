"""ratingloom.sources"""
