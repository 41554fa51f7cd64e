"""ratingloom.functions"""
