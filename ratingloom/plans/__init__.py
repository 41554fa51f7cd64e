"""ratingloom.plans"""
