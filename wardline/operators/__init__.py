"""wardline.operators"""
