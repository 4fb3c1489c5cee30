"""wardline.streaming"""
